"""Katz back-off language model over words, of any order.

Counts of words, pairs and longer n-grams are gathered by hash ranges: every block of documents
sends its distinct n-grams of each length with their counts in training texts, and gets the
counts over all training texts back. Good-Turing discounts come from each length's counts of
counts. A context's back-off weight is what its seen n-grams leave, over what their last words
leave of the model one order lower, so every context's probabilities sum to 1. With h' for h
without its first word:

    P(w | h) = discounted c(h, w) / c(h)   if the n-gram was seen
             = weight(h) * P(w | h')       if only h was
             = P(w | h')                   if h was not

A seen n-gram's shorter ends were seen too, so the lower model's part of a weight is a
discounted count itself, and weights of all orders are made in one step. A text begins with one
mark, so its first words have the contexts that are there.

Words and pairs are counted in one step, and each longer length in one of its own. An n-gram with
a shorter part that no other block holds is in no other block either: its count, and the weight
of a context that is in one block only, are known at home. Only contexts that are in some text
not learned from send what their weights are made of, as no other text backs off.

The word model gives the discounted mass to the one class of unknown words. N-grams are told
apart by 64-bit hashes. Counts, weights and requests are tables in the shared folder,
partitioned by hash range; no count is cut off, and all grow with the corpus.

Null text is empty: the end token alone. Rows with a null id are scored and not learned from.
With nothing to learn from, the word model has the unknown class alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.blocks import MESSAGE, Block, answer, ask, blocks, bucket_of, by_bucket, distinct, dump, dump_sorted, load, load_sorted, with_answers
from panelforge.llm.common import documents, step_done, written
from panelforge.llm.words import word_hashes

GOOD_TURING_UP_TO = 5
BLOCK_TEXT, BUCKET_TEXT = 4 << 20, 8 << 20
#: Hashes of the end token and of a text's beginning.
END, BEGIN = np.uint64(1), np.uint64(2)
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def smoothed(counts_of_counts: list[int]) -> list[float]:
    """Counts of counts made a falling power of the count: the line of least squares through their logarithms.

    Each point weighs its count of counts. The slope is the data's own; only one above -1.05, over
    which Good-Turing's expected counts would not fall below the counts, becomes -1.05. Steeper
    slopes keep ratios between 0 and 1 whatever they are. One point or none takes a slope of -2.
    """
    points = [(math.log(r), math.log(n), n) for r, n in enumerate(counts_of_counts) if r and n]
    total = sum(w for *_, w in points)
    x0, y0 = (sum(w * p[i] for *p, w in points) / total for i in (0, 1)) if points else (0.0, 0.0)
    spread = sum(w * (x - x0) ** 2 for x, _, w in points)
    slope = sum(w * (x - x0) * (y - y0) for x, y, w in points) / spread if spread else -2.0
    slope = min(slope, -1.05)
    return [0.0, *(math.exp(y0 + slope * (math.log(r) - x0)) for r in range(1, len(counts_of_counts)))]


def discounts(counts_of_counts: list[int], k: int = GOOD_TURING_UP_TO) -> list[float]:
    """Amount taken off a count r, for r = 0 to k + 1; from k + 1 on it stays the same.

    Katz's ratios from Good-Turing's expected counts, over smoothed counts of counts, which
    always give ratios between 0 and 1. Above k the amount at k goes on, so that every seen
    context leaves some mass.
    """
    n = smoothed(counts_of_counts)
    a = (k + 1) * n[k + 1] / n[1]
    ratios = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)]
    off = [0.0, *(r * (1 - d) for r, d in enumerate(ratios, 1))]
    return [*off, off[k]]


@dataclass
class Words:
    """The word model: tokens, types, what is taken off each count, and the unknown class."""

    tokens: int
    types: int
    off: list[float]
    unknown: float

    @classmethod
    def of(cls, tokens: int, types: int, counts_of_counts: list[int]) -> Words:
        off, k = discounts(counts_of_counts), GOOD_TURING_UP_TO
        freed = sum(off[r] * counts_of_counts[r] for r in range(1, k + 1)) + off[k + 1] * (types - sum(counts_of_counts[1 : k + 1]))
        return cls(tokens, types, off, freed / tokens if tokens else 1.0)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        taken = np.array(self.off)[np.minimum(counts, len(self.off) - 1)]
        return np.where(counts > 0, (counts - taken) / max(self.tokens, 1), self.unknown)


@dataclass
class Level:
    """A block's distinct n-grams of one length, in order of their hashes.

    tested: whether a text that is not learned from has it. where: the tokens that end one, and at: which. context, end: the n-gram one shorter before
    the last word (-1 for a text's beginning) and after the first, by place in the level below.
    """

    values: np.ndarray
    counts: np.ndarray
    tested: np.ndarray
    where: np.ndarray
    at: np.ndarray
    context: np.ndarray
    end: np.ndarray


class Tokens:
    """A block's tokens: distinct n-grams of each length up to order, and each token's place among them."""

    def __init__(self, block: Block, mod: int, order: int):
        parts, sizes = [], []
        for a, b in zip(block.starts.tolist(), block.ends.tolist(), strict=True):
            h = word_hashes(block.data[a:b])
            parts.append(h)
            sizes.append(len(h) + 1)
        self.sizes = np.array(sizes, np.int64)
        ends = np.cumsum(self.sizes) - 1
        words = np.full(int(self.sizes.sum()), END)
        inner = np.ones(len(words), bool)
        inner[ends] = False
        words[inner] = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        self.learn = np.array([i is not None and zlib.crc32(str(i).encode()) % mod != 0 for i in block.ids], bool)
        taught = self.learn[self.doc].astype(np.int64)
        place = np.arange(len(words)) - np.repeat(ends + 1 - self.sizes, self.sizes)
        self.levels: list[Level] = []
        hashes, below = words, np.zeros(0, np.int64)
        for n in range(1, order + 1):
            where = np.flatnonzero(place >= n - 2)
            before = np.where(place[where] > 0, hashes[where - 1], BEGIN)
            if n > 1:
                mixed = (before * _FACTOR + words[where]) * _MIX
                mixed ^= mixed >> np.uint64(31)
                hashes = np.zeros_like(words)
                hashes[where] = mixed * _FACTOR
            values, first, at = distinct(hashes[where])
            context = np.where(place[where[first]] > 0, below[where[first] - 1], -1) if n > 1 else first
            end = below[where[first]] if n > 1 else first
            counts = np.bincount(at, taught[where], len(values)).astype(np.uint32)
            tested = np.zeros(len(values), bool)
            tested[at[taught[where] == 0]] = True
            self.levels.append(Level(values, counts, tested, where, at, context, end))
            below = np.full(len(words), -1)
            below[where] = at


@dataclass
class Known:
    """What a block knows of the n-grams of one length: their counts over all blocks, whether it is
    the one block to account for each, whether no other block has it, and whether any text that is
    not learned from does.
    """

    count: np.ndarray
    owner: np.ndarray
    alone: np.ndarray
    tested: np.ndarray


def _at_home(level: Level, shorter: Known) -> np.ndarray:
    """The n-grams with a shorter part that no other block has."""
    return shorter.alone[level.context] | shorter.alone[level.end]


def _known(t: Tokens, buckets: int, answers: dict[tuple[int, int], bytes], lengths: int) -> list[Known]:
    """For each of the first lengths: words and pairs by answers alone, longer ones at home where they can be."""
    out: list[Known] = []
    for n, level in enumerate(t.levels[:lengths]):
        home = _at_home(level, out[-1]) if n > 1 else np.zeros(len(level.values), bool)
        one = Known(level.counts.astype(np.int64), home.copy(), home.copy(), level.tested.copy())
        asked = np.flatnonzero(~home)
        for bucket, part in by_bucket(bucket_of(level.values[asked], buckets)):
            if (body := answers.get((1, bucket + n * buckets))) is not None:
                count, *flags, _ = load(body)
                places = asked[part]
                one.count[places] = count
                one.owner[places], one.alone[places], one.tested[places] = (np.unpackbits(f, count=len(count)) for f in flags)
        out.append(one)
    return out


def _stats(counts: np.ndarray) -> np.ndarray:
    """The number of values of each count up to GOOD_TURING_UP_TO + 1, of all seen values, and their sum."""
    return np.append(np.bincount(np.minimum(counts, GOOD_TURING_UP_TO + 2), minlength=GOOD_TURING_UP_TO + 3)[: GOOD_TURING_UP_TO + 2], [int((counts > 0).sum()), int(counts.sum())])


def _asked(level: Level, n: int, buckets: int, home: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Messages about a length's n-grams that are not at home; the first has the statistics of those that are."""
    away = np.flatnonzero(~home)
    parts = [(b, away[p]) for b, p in by_bucket(bucket_of(level.values[away], buckets))] or ([(0, away)] if home.any() else [])
    told = _stats(level.counts[home].astype(np.int64))
    return [
        (b + n * buckets, 1, dump(np.frombuffer(dump_sorted(level.values[p]), np.uint8), level.counts[p], np.packbits(level.tested[p]), told if i == 0 else told[:0]))
        for i, (b, p) in enumerate(parts)
    ]


def _ask_pairs(block: Block, mod: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    for n, level in enumerate(Tokens(block, mod, 2).levels):
        yield from _asked(level, n, buckets, np.zeros(len(level.values), bool))


def _ask_longer(block: Block, answers: dict[tuple[int, int], bytes], mod: int, buckets: int, length: int) -> list[list]:
    t = Tokens(block, mod, length)
    home = _at_home(t.levels[-1], _known(t, buckets, answers, length - 1)[-1])
    rows = _asked(t.levels[-1], length - 1, buckets, home)
    return [[block.number] * len(rows), *map(list, zip(*rows, strict=True))] if rows else [[]] * 4


def _sum_counts(bodies: list[bytes]) -> list[bytes]:
    """For every block's values: the count over all blocks, and the flags of Known as bits.

    The first answer also holds the statistics of the bucket's counts and of those at home.
    """
    parts = [load(b) for b in bodies]
    values = [load_sorted(p[0].tobytes()) for p in parts]
    sizes = list(map(len, values))
    found, some, back = distinct(np.concatenate(values))
    total = np.bincount(back, np.concatenate([p[1] for p in parts]), len(found)).astype(np.int64)
    tests = np.concatenate([np.unpackbits(p[2], count=n) for p, n in zip(parts, sizes, strict=True)])
    owner = np.zeros(len(back), bool)
    owner[some] = True
    alone, tested = np.bincount(back, minlength=len(found)) == 1, np.bincount(back, tests, len(found)) > 0
    stats = sum((p[3] for p in parts if len(p[3])), _stats(total))
    cuts = np.cumsum(sizes)[:-1]
    answers = zip(*(np.split(x, cuts) for x in (total[back], owner, alone[back], tested[back])), strict=True)
    return [dump(t, *map(np.packbits, flags), stats if i == 0 else stats[:0]) for i, (t, *flags) in enumerate(answers)]


def _statistics(answers: DataFrame, buckets: int, order: int) -> list[list[int]]:
    """Summed statistics of each length of n-grams; summed on the executors."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            sums = np.zeros((order, GOOD_TURING_UP_TO + 4), np.int64)
            for bucket, body in zip(b.column("bucket").to_pylist(), b.column("body").to_pylist(), strict=True):
                if len(stats := load(body)[-1]):
                    sums[bucket // buckets] += stats
            yield pa.RecordBatch.from_pydict({"kind": pa.array(range(order), pa.int32()), "s": pa.array(sums.tolist(), pa.list_(pa.int64()))})

    rows = answers.select("bucket", "body").mapInArrow(run, "kind int, s array<bigint>")
    sums = rows.groupBy("kind").agg(*[F.sum(F.col("s")[i]) for i in range(GOOD_TURING_UP_TO + 4)]).collect()
    by = {r[0]: list(r[1:]) for r in sums}
    none = [0] * (GOOD_TURING_UP_TO + 4)
    return [by.get(n, none) for n in range(order)]


def _log10(x: np.ndarray) -> np.ndarray:
    return np.log10(x, out=np.zeros(len(x)), where=x > 0)


def _score(block: Block, answers: dict[tuple[int, int], bytes], mod: int, buckets: int, words: Words, texts: int, offs: list[list[float]]) -> list[list]:
    """Messages about contexts, and the block's own state (kind 9): all but the weights of contexts that other blocks have too."""
    t = Tokens(block, mod, len(offs) + 1)
    known = _known(t, buckets, answers, len(offs) + 1)
    c, word, n = known[0].count, t.levels[0].at, len(t.sizes)
    p_below = words.probability(c)
    log_p = _log10(p_below)[word]
    base = np.log10((c + 0.1) / (words.tokens + 0.1 * (words.types + 1)))
    per = lambda x: np.bincount(t.doc, x, n)
    rows, backed, weighed = [], [], np.zeros(n)
    for shift, (off, lower, level) in enumerate(zip(offs, t.levels, t.levels[1:], strict=False)):
        below, count, owner = known[shift], known[shift + 1].count, known[shift + 1].owner
        context = np.where(level.context < 0, texts, below.count[np.maximum(level.context, 0)])
        taken = np.array(off)[np.minimum(count, len(off) - 1)]
        p = np.divide(count - taken, context, out=np.zeros(len(count)), where=count > 0)
        seen = (count > 0)[level.at]
        log_p[level.where[seen]] = _log10(p)[level.at[seen]]
        at = np.flatnonzero(((count == 0) & (context > 0))[level.at])
        wanted, event = np.unique(level.context[level.at[at]], return_inverse=True)
        own = np.flatnonzero(owner & (count > 0))
        # the last place is the text's beginning, which -1 takes
        sums = np.stack([np.bincount(level.context[own] % (len(lower.values) + 1), x, len(lower.values) + 1) for x in ((count - taken)[own], p_below[level.end[own]])])
        inside, totals = np.append(below.alone, False), np.append(below.count, texts)
        weight = np.ones(len(wanted))
        here = inside[wanted]
        weight[here] = (1 - sums[0, wanted[here]] / totals[wanted[here]]) / (1 - sums[1, wanted[here]])
        weighed += np.bincount(t.doc[level.where[at]], np.log10(weight)[event], n)

        hashes = np.append(lower.values, BEGIN)
        away = ~here[event]
        asked = np.zeros(len(hashes), bool)
        asked[wanted[~here]] = True
        told = np.zeros(len(hashes), bool)
        told[level.context[own]] = True
        both = np.flatnonzero(asked | (told & ~inside & np.append(below.tested, True)))
        both = both[np.argsort(hashes[both])]
        places = both[asked[both]]
        number = np.zeros(len(hashes), np.int64)
        number[places] = np.arange(len(places))
        backed += [t.doc[level.where[at[away]]], number[wanted[event[away]]], bucket_of(hashes[places], buckets)]
        for bucket, part in by_bucket(bucket_of(hashes[both], buckets)):
            places = both[part]
            rows.append((bucket + shift * buckets, 3, dump(np.frombuffer(dump_sorted(hashes[places]), np.uint8), *sums[:, places], totals[places], np.packbits(asked[places]))))
        p_below = p
    state = dump(block.order, t.learn.astype(np.uint8), t.sizes, per(c[word] > 0).astype(np.int64), per(base[word]), per(log_p) + weighed, *backed)
    rows.append((-1, 9, state))
    return [[block.number] * len(rows), *map(list, zip(*rows, strict=True))]


def _weights(bodies: list[bytes]) -> list[bytes]:
    """The back-off weights that every block asks for, in its order."""
    parts = [load(b) for b in bodies]
    values = [load_sorted(p[0].tobytes()) for p in parts]
    found, back = np.unique(np.concatenate(values), return_inverse=True)
    s1, s2 = (np.bincount(back, np.concatenate([p[i] for p in parts]), len(found)) for i in (1, 2))
    total = np.ones(len(found))
    total[back] = np.concatenate([p[3] for p in parts])
    weight = ((1 - s1 / total) / (1 - s2))[back]
    cuts = np.cumsum([len(v) for v in values])[:-1]
    return [dump(w[np.unpackbits(p[4], count=len(w)).astype(bool)]) for w, p in zip(np.split(weight, cuts), parts, strict=True)]


def scored(df: DataFrame, mod: int = 10, key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from rows whose crc32(key as text) modulo mod is not 0. order: words of the longest
    n-grams, 2 or more.
    """
    table = blocks(df, key, text, bytes.lower, BLOCK_TEXT)
    total = table.select(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(1, total // BUCKET_TEXT)
    tables = [answer(ask(table, lambda block: _ask_pairs(block, mod, buckets), "counts"), _sum_counts, 1)]
    for length in range(3, order + 1):
        asks = with_answers(table, _all(tables).where(F.col("bucket") >= buckets), lambda block, answers: _ask_longer(block, answers, mod, buckets, length), MESSAGE)  # noqa: B023
        tables.append(answer(asks, _sum_counts, 1))
    counts = _all(tables)
    by_word, *longer = _statistics(counts, buckets, order)
    words = Words.of(by_word[-1], by_word[-2], by_word[:-2])
    offs = [discounts(x[:-2]) for x in longer]
    texts = _learned(table, mod)
    out = written(with_answers(table, counts, lambda block, answers: _score(block, answers, mod, buckets, words, texts, offs), MESSAGE), "contexts")
    step_done(table, *tables)
    weights = answer(out.where("kind = 3"), _weights, 4)

    def finish(left, right):
        import pyarrow as pa

        by = dict(zip(right.column("bucket").to_pylist(), right.column("body").to_pylist(), strict=True))
        rows: list[tuple] = []
        for body in left.column("body").to_pylist():
            keys, learn, sizes, known, base, score, *backed = load(body)
            for n in range(order - 1):
                doc, event, wanted = backed[3 * n : 3 * n + 3]
                weight = np.ones(len(wanted))
                for bucket, part in by_bucket(wanted):
                    weight[part] = load(by[bucket + n * buckets])[0]
                score = score + np.bincount(doc, np.log10(weight)[event], len(score))
            ids = [None if i == np.iinfo(np.int64).max else i for i in keys.tolist()]
            held = [i is not None and not x for i, x in zip(ids, learn.tolist(), strict=True)]
            rows += zip(ids, held, sizes.tolist(), known.tolist(), [words.tokens] * len(ids), base.tolist(), score.tolist(), strict=True)
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    result = out.where("kind = 9").groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(finish, "k bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return result.withColumn("k", F.col("k").cast(df.schema[key].dataType)).withColumnRenamed("k", key)


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, tables)


def _learned(table: DataFrame, mod: int) -> int:
    ids = table.select(F.explode("ids").alias("i"))
    return ids.where(F.crc32(F.col("i").cast("string").cast("binary")) % mod != 0).count()


def op4_katz(spark: SparkSession, sf_dir: str, order: int = 2) -> DataFrame:
    return scored(documents(spark, sf_dir), order=order)
