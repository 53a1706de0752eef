"""Quality rules under weak supervision: rules vote, EM weighs them, a posterior decides.

Each rule votes good (1), bad (-1) or abstains (0). The number of texts with each pattern of
votes is one aggregation over all rows; there are at most 3 ** len(RULES) patterns, whatever
the input. Expectation-maximisation over these counts estimates the share of good texts and,
for each rule and each class, how often it votes each way. A text's posterior is then a
column expression. Only SQL functions touch the texts.

Null text has no words. Empty texts, repeated rows and empty tables are ordinary cases: the
latter leaves the starting rates as they are and gives an empty result. Null ids are kept.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import documents, written

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT, SYMBOLS = 5, 10, 20, "#*$%&|<>"
#: Rule name, SQL for a good vote, SQL for a bad vote, over the columns of measured().
RULES: tuple[tuple[str, str, str], ...] = (
    ("length", "n_words >= 20", "n_words < 10"),
    ("repeats", "100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 20 * n_words"),
    ("lines", "100 * n_dup_lines <= 10 * n_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("symbols", "1000 * n_symbols <= 5 * word_chars", "100 * n_symbols > 5 * word_chars"),
    ("letters", "100 * n_letters >= 85 * word_chars", "100 * n_letters < 60 * word_chars"),
    ("digits", "100 * n_digits <= 5 * word_chars", "100 * n_digits > 20 * word_chars"),
    ("word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars NOT BETWEEN 2 * n_words AND 14 * n_words"),
    ("variety", "n_distinct >= 3 * sqrt(n_words)", "n_distinct < 1.5 * sqrt(n_words)"),
    ("stops", "n_stops >= 1", "n_stops = 0 AND n_words >= 30"),
)
PRIOR_GOOD, START_RIGHT, ROUNDS, SMOOTH = 0.8, 0.8, 30, 1.0


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def measured(df: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys and the measures of every text.

    n_repeat_words: words in windows of WINDOW words whose words stand in the text twice or
    more. Windows are compared by 64-bit hashes; only texts with equal hashes are sorted.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    drop = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    words = "filter(split(t, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    keyed = df.select(*keys, t.alias("t")).withColumn("words", F.expr(words))
    hashes = f"CASE WHEN size(words) < {WINDOW} THEN cast(array() AS array<bigint>) ELSE transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))) END"
    pair = "named_struct('h', x, 'i', i)"
    in_group = "(i > 0 AND s[i - 1].h = x.h) OR (i + 1 < size(s) AND s[i + 1].h = x.h)"
    covered = f"aggregate(sequence(0, size(p) - 1), 0, (a, i) -> a + CASE WHEN i + 1 < size(p) THEN least({WINDOW}, p[i + 1] - p[i]) ELSE {WINDOW} END)"
    places = f"sort_array(transform(filter(transform(s, (x, i) -> CASE WHEN {in_group} THEN x.i END), y -> y IS NOT NULL), y -> y))"
    repeated = _let("s", f"sort_array(transform(h, (x, i) -> {pair}))", _let("p", places, covered))
    n_repeat = f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE {repeated} END"
    lines = "filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    n_dup = _let("ls", lines, "named_struct('n', size(ls), 'dup', size(ls) - size(array_distinct(ls)))")
    return (
        keyed.withColumn("h", F.expr(hashes))
        .withColumn("ln", F.expr(n_dup))
        .select(
            *keys,
            F.size("words").cast("long").alias("n_words"),
            F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            drop(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
            F.col("ln.dup").cast("long").alias("n_dup_lines"),
            F.expr(n_repeat).cast("long").alias("n_repeat_words"),
            F.col("ln.n").cast("long").alias("n_lines"),
            F.length(F.regexp_replace("t", r"[^\p{L}\p{M}]+", "")).cast("long").alias("n_letters"),
            drop(F.col("t"), "0123456789").cast("long").alias("n_digits"),
            F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
            drop(F.col("t"), ".!?").cast("long").alias("n_stops"),
        )
    )


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def votes(df: DataFrame) -> DataFrame:
    """df with a column vote_<rule> for each rule."""
    return df.withColumns({f"vote_{name}": F.expr(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END") for name, good, bad in RULES})


def estimated(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """The share of good texts, and for each rule a vote's rate among (good, bad) texts.

    Starts from rules that are mostly right, which names the classes. SMOOTH is added to each
    count, so no rate is 0.
    """
    n = len(RULES)
    share = PRIOR_GOOD
    rates = [{1: (START_RIGHT, 1 - START_RIGHT), -1: (1 - START_RIGHT, START_RIGHT), 0: (0.5, 0.5)} for _ in range(n)]
    for _ in range(ROUNDS):
        sums = [{v: [SMOOTH, SMOOTH] for v in (1, 0, -1)} for _ in range(n)]
        good = total = 0.0
        for vote, count in patterns:
            p = posterior(vote, share, rates)
            good, total = good + p * count, total + count
            for j, v in enumerate(vote):
                sums[j][v][0] += p * count
                sums[j][v][1] += (1 - p) * count
        if not total:
            break
        share = min(max((good + SMOOTH) / (total + 2 * SMOOTH), 1e-6), 1 - 1e-6)
        rates = [{v: (s[v][0] / sum(x[0] for x in s.values()), s[v][1] / sum(x[1] for x in s.values())) for v in s} for s in sums]
    return share, rates


def posterior(vote: Sequence[int], share: float, rates: list[dict[int, tuple[float, float]]]) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(r[v][0] / r[v][1]) for v, r in zip(vote, rates, strict=True) if v)
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def judged(measures: DataFrame) -> DataFrame:
    """measures with the votes, base_failed, the posterior p_good, and kept."""
    voted = votes(measures)
    names = [f"vote_{name}" for name, _, _ in RULES]
    counts = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** len(RULES) rows
    share, rates = estimated([(tuple(r[:-1]), r[-1]) for r in sorted(counts)])
    odds = F.lit(math.log(share / (1 - share)))
    for name, r in zip(names, rates, strict=True):
        gain = {v: math.log(r[v][0] / r[v][1]) for v in (1, -1)}
        odds = odds + F.when(F.col(name) == 1, gain[1]).when(F.col(name) == -1, gain[-1]).otherwise(0.0)
    return voted.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = judged(written(measured(documents(spark, sf_dir)), "quality"))
    return table.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
