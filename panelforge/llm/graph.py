"""Connected components by alternating stars, all in joins and aggregations; a few links are joined by one task."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import written

#: Links that one task joins by itself.
FEW_LINKS = 10_000


def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node it reaches, for every node of edges (a, b) but the smallest ones.

    Each round links neighbours to the smallest one they share, first those above a node,
    then those below. Rounds grow with the logarithm of the longest path. Each round's links
    are written, so a lost executor costs one round at most.
    """
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "links")
    before = _mark(links)
    if before[0] <= FEW_LINKS:
        return _at_once(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.least("v", F.min("m")).alias("least"))
        large = both.join(least, "v").where("m > v").select(F.col("m").alias("v"), F.col("least").alias("m")).where("v <> m").distinct()
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct("v", F.col("least").alias("m")), F.struct(F.col("m").alias("v"), F.col("least").alias("m")))).alias("x")).select("x.*")
        links = written(small.where("v <> m").distinct(), "links")
        after = _mark(links)
        if after == before:
            break
        before = after
    return links.select(F.col("v").alias("node"), F.col("m").alias("component"))


def _at_once(links: DataFrame) -> DataFrame:
    """The components of links (v, m), in one task."""
    kind = links.schema["v"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        up: dict = {}

        def least(node):
            top = node
            while top in up:
                top = up[top]
            while node != top:
                up[node], node = top, up[node]
            return top

        for b in batches:
            for v, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (x := least(v)) != (y := least(m)):
                    up[max(x, y)] = min(x, y)
        found = [(n, least(n)) for n in list(up)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, b.schema.field(0).type) for c in zip(*found, strict=True)], names=["node", "component"])

    return links.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "m"))).first())
