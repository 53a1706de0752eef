"""Models that are fitted by passes over packed blocks of rows: each pass is one map with sums inside tasks and one aggregation.

Blocks are stored once as matrices, so a pass costs numpy arithmetic and not a row's way through
Python. What comes back to the driver has the size of the model's equations, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.sources.tables import stored

ROWS = 8192
#: The column that says for how many rows one stands.
TIMES = "_times"


def alike(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """columns as doubles (nulls are 0), each combination of values once, and TIMES.

    Passes then cost by combinations: features made of counts come again and again, continuous
    ones give a row each, as many as there were.
    """
    clean = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    return df.select(*clean).groupBy(*columns).agg(F.count(F.lit(1)).alias(TIMES))


def packed(df: DataFrame, columns: Sequence[str], rows: int = ROWS) -> DataFrame:
    """A stored table of blocks: data, a matrix of doubles with a row for each row; nulls are 0."""
    width = len(columns)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) if b.num_rows else np.empty((0, width))
            for at in range(0, len(m), rows):
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(m[at : at + rows]).tobytes()], pa.binary())], names=["data"])

    clean = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)]
    return stored(df.select(*clean).mapInArrow(run, "data binary"), "blocks")


def totals(blocks: DataFrame, shape: tuple[int, ...], kind: type, fn: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum of fn(*binary columns of a block) over all blocks; kind: np.int64 or np.float64."""
    size = int(np.prod(shape))

    def run(batches):
        import pyarrow as pa

        total = np.zeros(size, kind)
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total += fn(*row).reshape(-1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["i", "v"])

    sums = blocks.mapInArrow(run, f"i int, v {'long' if kind is np.int64 else 'double'}").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size, kind)
    out[sums["i"].to_numpy()] = sums["v"].to_numpy()
    return out.reshape(shape)
