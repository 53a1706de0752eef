"""Language of texts: known words first, then ever shorter character n-grams.

A word that training knows scores its log frequency in each language. Any other word falls
back to its n-grams: the longest length of which at least one is known decides, as the mean
of their log frequencies. A text's score for a language is the sum over its words, and the
reported score is the share that the language has of all of them.

Training counts words and n-grams with Spark over labelled texts. Up to FIT_ROWS labelled
rows are drawn for each language, by a hash of the whole row; that is the one bound of the
model that the workers get. All words and n-grams of these rows are in it, in every language.

Null text and texts without letters are `und` with score 0. A language that is null is not
learned. With nothing to learn from, every text is `und`. Empty texts, repeated rows and
empty tables need no rule of their own.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import documents, lone, map_values, quoted, remainder, written

FIT_ROWS, LONGEST = 200, 5
#: Log frequency, in each language, of what it has not shown.
FLOOR = 0.5
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    """Runs of letters; number signs such as one half or roman numerals are none."""
    found = _WORDS.findall(text.lower())
    return found if "".join(found).isalpha() else [w for part in found for w in _LETTERS.findall(part)]


def grams_of(word: str, n: int) -> list[str]:
    marked = f"\x02{word}\x03"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Scores of words; made from rows (kind, item, lang, count), kind 0 for words, else n.

    Items counted alike share one list of scores, also in the workers' copies.
    """

    def __init__(self, rows: list[tuple[int, str, str, int]]):
        self.langs = sorted({lang for _, _, lang, _ in rows})
        place = {lang: i for i, lang in enumerate(self.langs)}
        totals: dict[int, list[int]] = defaultdict(lambda: [0] * len(place))
        counts: dict[int, dict[str, list[int]]] = defaultdict(dict)
        for kind, item, lang, count in rows:
            counts[kind].setdefault(item, [0] * len(place))[place[lang]] += count
            totals[kind][place[lang]] += count
        self.tables: dict[int, dict[str, list[float]]] = {}
        for kind, items in counts.items():
            alike = {tuple(cs): [math.log((c + FLOOR) / (t + FLOOR * len(items))) for c, t in zip(cs, totals[kind], strict=True)] for cs in set(map(tuple, items.values()))}
            self.tables[kind] = {item: alike[tuple(cs)] for item, cs in items.items()}
        self.memory: dict[str, list[float] | None] = {}

    def word(self, word: str) -> list[float] | None:
        """Log frequency in each language; None if not even one letter is known."""
        if (found := self.tables.get(0, {}).get(word)) is not None:
            return found
        if word in self.memory:
            return self.memory[word]
        if len(self.memory) > 100_000:
            self.memory.clear()
        out = None
        for n in range(LONGEST, 0, -1):
            known = [s for g in grams_of(word, n) if (s := self.tables.get(n, {}).get(g)) is not None]
            if known:
                out = [sum(c) / len(known) for c in zip(*known, strict=True)]
                break
        self.memory[word] = out
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words_of(text or ""))
        sums, seen = [0.0] * len(self.langs), False
        for word, n in counts.items():
            if (scores := self.word(word)) is not None:
                seen = True
                sums = [a + n * s for a, s in zip(sums, scores, strict=True)]
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        if not seen:  # letters that no language has shown: the first language, without support
            return self.langs[0], 0.0
        best = max(range(len(sums)), key=sums.__getitem__)
        return self.langs[best], 1 / sum(math.exp(max(s - sums[best], -700.0)) for s in sums)


def fitted(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from rows with a language; counts are made on the executors.

    Rows are drawn by a threshold on a hash, set by each language's number of rows.
    """
    spark = labelled.sparkSession
    place = F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in labelled.columns]), F.lit(1 << 20))
    rows = labelled.select(F.col(quoted(text)).alias("text"), F.col(quoted(lang)).alias("lang"), place.alias("place")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).collect()  # a row a language, as many as the model has
    limits = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], -(-(FIT_ROWS << 20) // r["rows"]))]) if sizes else None
    # place * rows < FIT_ROWS << 20, in whole numbers; texts stay where they are
    drawn = F.col("place") < F.try_element_at(limits, F.col("lang")) if sizes else F.lit(False)
    sample = rows.where(drawn).select("text", "lang")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[lang].update(words_of(text))
        for lang, words in found.items():
            kinds: dict[int, Counter] = {0: words, **{n: Counter() for n in range(1, LONGEST + 1)}}
            for word, c in words.items():
                for n in range(1, LONGEST + 1):
                    for g in grams_of(word, n):
                        kinds[n][g] += c
            for kind, items in kinds.items():
                k = len(items)
                yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * k, pa.int32()), "item": pa.array(list(items), pa.string()), "lang": pa.array([lang] * k, pa.string()), "n": pa.array(list(items.values()), pa.int64())})

    counts = sample.mapInArrow(count, "kind int, item string, lang string, n bigint").groupBy("kind", "item", "lang").agg(F.sum("n").alias("n"))
    kept = written(counts, "langid-model")
    return Model([tuple(r) for r in kept.select("kind", "item", "lang", "n").orderBy("kind", "item", "lang").toLocalIterator()])  # bounded by FIT_ROWS


def predicted(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep, lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> list[list]:
        lone("languages", lambda: True)  # what a worker holds for another stage goes; the model stays Spark's to drop
        out = [shared.value.predict(t) for t in texts]
        return [[lang for lang, _ in out], [score for _, score in out]]

    return map_values(df, keep, text, "lang_pred string, score double", run)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = documents(spark, sf_dir).withColumn("held_out", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)))
    model = fitted(table.where(remainder("doc_id", 4) != 2))
    return predicted(table, model, ["doc_id", "held_out"])
