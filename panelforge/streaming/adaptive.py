"""Adaptive bands as a stream: cuts arrive one after another, and each moves the level of its regime."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelforge.operators.bands import ADAPTED, Level

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AdaptiveBand(StatefulProcessor):
    """State of a gamma and regime: the level, the last cut, and how often each residual was seen.

    A batch holds whole cuts, and none before the last one; anything else is an error, as a level
    that has moved can't be taken back.
    """

    def __init__(self, target: float, start: int):
        self.target, self.start = target, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "level double, p int")
        self.seen = handle.getMapState("seen", "residual double", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        batch = pd.concat(list(rows)).groupby(["p", "residual"], as_index=False)["n"].sum()
        level, last = self.level.get() if self.level.exists() else (self.target, None)
        if last is not None and batch["p"].min() <= last:
            raise ValueError(f"cut {batch['p'].min()} of {key} came after cut {last}")
        seen = {float(k[0]): int(v[0]) for k, v in self.seen.iterator()}
        moving = Level(key[0], self.target, level)
        out = moving.walked(batch, self.start, key[1], seen)
        for residual, n in batch.groupby("residual")["n"].sum().items():
            self.seen.updateValue((float(residual),), (seen.get(float(residual), 0) + int(n),))
        self.level.update((float(moving.level), int(batch["p"].max())))
        yield out

    def close(self) -> None:
        pass


def adaptive(counts: DataFrame, gammas: Sequence[float], target: float, start: int) -> DataFrame:
    """bands.adaptive of a stream of counts (regime, p, residual, n)."""
    each = counts.withColumn("gamma", F.explode(F.array(*map(F.lit, gammas))))
    return each.groupBy("gamma", "regime").transformWithStateInPandas(AdaptiveBand(target, start), ADAPTED, "append", "None")


@contextmanager
def rocks(spark: SparkSession):
    """The state store that such streams need, for queries that start inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)
