"""Best-fit decreasing packing of token sequences, exact over all rows.

Which bin a piece goes to depends only on its length, so best-fit decreasing runs on the
number of pieces of each length: at most one row a length. Bins that are filled alike are
one run of bins. A segment tree over the remaining capacities gives the tightest open
capacity that still fits in logarithmic time; a whole run of pieces is placed at once. The
plan is a table of a few thousand rows; the n-th piece of a length then finds its bin by a
join. Places among pieces of one length are counted in as many buckets as its number of
pieces asks for, so that no length is counted in one task.

Null text is empty: the end id alone. Only documents over the capacity are cut; the first
piece takes what is over a multiple of it. Repeated rows are packed one by one. An empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import documents, map_values, written
from panelforge.llm.encoding import KEPT, ROOMY, as_array, library_encoder

VOCABULARY, END, CAPACITY = "byte_bpe_50k.json", 0, 2048
#: Pieces of one length that one task ranks; they may carry their ids, 8 KB for a full one.
PER_BUCKET = 1 << 12


class CapacityTree:
    """Bins open at each remaining capacity; tightest(n) finds the least capacity >= n."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.size
        while i:
            self.sums[i] += bins
            i //= 2

    def tightest(self, least: int) -> int | None:
        i = least + self.size
        if self.sums[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.sums[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.sums[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


@dataclass
class Run:
    """Bins first to first + bins - 1, all filled alike."""

    first: int
    bins: int


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from, to, each, bin, offset): pieces from to to - 1 of a length lie each to a bin, from bin on.

    counts: pieces of each length. Best fit puts a piece into the tightest open bin; the next
    piece of that length then fits no bin tighter than what is left of this one, so bins are
    filled up one after another.
    """
    tree, runs, bins, out = CapacityTree(capacity), defaultdict(list), 0, []
    for length in sorted(counts, reverse=True):
        done, n = 0, counts[length]
        while done < n:
            room = tree.tightest(length)
            if room is None:
                room, run = capacity, Run(bins, -(-(n - done) // (capacity // length)))
                bins += run.bins
            else:
                run = runs[room].pop()
                tree.add(room, -run.bins)
            each = room // length
            full = min(run.bins, (n - done) // each)
            if full:
                out.append((length, done, done + full * each, each, run.first, capacity - room))
                done += full * each
                _open(tree, runs, room - each * length, Run(run.first, full))
            rest = Run(run.first + full, run.bins - full)
            if rest.bins and done < n:  # fewer than a bin takes are left
                out.append((length, done, n, n - done, rest.first, capacity - room))
                _open(tree, runs, room - (n - done) * length, Run(rest.first, 1))
                done, rest = n, Run(rest.first + 1, rest.bins - 1)
            if rest.bins:
                _open(tree, runs, room, rest)
    return out


def _open(tree: CapacityTree, runs: dict[int, list[Run]], room: int, run: Run) -> None:
    if room:
        runs[room].append(run)
        tree.add(room, run.bins)


def pieces(df: DataFrame, vocabulary: str, end: int, capacity: int, key: str = "doc_id", text: str = "text", with_ids: bool = True, kept: int = KEPT) -> DataFrame:
    """key, piece, start, length, ids_crc32, and ids (little-endian unsigned 32-bit) if asked for. kept: chunks that a worker remembers."""
    tail = end.to_bytes(4, "little")

    def run(texts: list) -> list[list]:
        encoder, out = library_encoder(vocabulary, True, kept), []
        for ids in encoder.all_ids([t or "" for t in texts]):
            ids += tail
            n = len(ids) // 4
            cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
            out.append([(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), *([ids[4 * a : 4 * b]] if with_ids else [])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
        names = ["piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
        return [[[dict(zip(names, p, strict=True)) for p in doc] for doc in out]]

    kind = "piece:int,start:bigint,length:bigint,ids_crc32:bigint" + (",ids:binary" if with_ids else "")
    table = map_values(df, [key], text, f"pieces array<struct<{kind}>>", run)
    return table.select(F.col(key), F.inline("pieces"))


def packed(parts: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """parts with sequence_id and offset. parts must be a stored table: it is read twice."""
    spark = parts.sparkSession
    sizes = written(parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "packing-lengths")
    buckets = sizes.select("length", F.ceil(F.col("n") / PER_BUCKET).alias("buckets"))
    salted = parts.join(F.broadcast(buckets), "length")  # at most capacity rows
    salted = salted.withColumn("bucket", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.col("buckets"))).drop("buckets")
    sums = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "packing-counts")
    counts = {r.length: r.n for r in sizes.collect()}  # at most capacity rows
    rows = plan(counts, capacity)
    columns = ["length", "lo", "hi", "each", "bin", "room_from"]
    # an Arrow table needs no Python workers, which would stay beside those with tokenizers
    bins = spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(columns)}))
    rank = Window.partitionBy("length", "bucket").orderBy(key, "piece", "ids_crc32")
    placed = salted.withColumn("r", F.row_number().over(rank) - 1)
    placed = placed.join(sums, ["length", "bucket"]).withColumn("r", F.col("r") + F.col("before"))
    # the plan has a few rows for each length
    found = placed.join(F.broadcast(bins), (placed["length"] == bins["length"]) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))).drop(bins["length"])
    return (
        found.withColumn("sequence_id", F.expr("bin + (r - lo) div each"))
        .withColumn("offset", F.expr("room_from + ((r - lo) % each) * length"))
        .select(*parts.columns, "sequence_id", "offset")
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return packed(written(pieces(documents(spark, sf_dir), path, END, CAPACITY, with_ids=False, kept=ROOMY), "pieces"), CAPACITY)
