"""Shadow monitoring as streams: an append-only log of forecasts and scores of months that are observed later.

Each micro-batch writes one folder that is named by its number, and reads only folders of
smaller numbers; what else it has read is fenced in a folder of that number too. A batch that
is replayed after a failure thus finds what it found before and replaces its own folder by the
same rows: nothing is logged or scored twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators import monitoring

LOG_KEYS = ("p", "model")
SCORE_KEYS = ("p", "model", "target", "sensor", "version")


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def batches(spark: SparkSession, folder: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Rows of all batches, or of those before one, with the batch's number; none where no batch was written yet."""
    schema = T.StructType([f for f in schema.fields if f.name != "batch"] + [T.StructField("batch", T.IntegerType())])
    if not _there(spark, folder):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(folder)
    return rows if before is None else rows.where(F.col("batch") < before)


def fenced(rows: DataFrame, folder: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def record(rows: DataFrame, batch: int, log: str) -> None:
    """Logs the forecasts (geo, p, model, pred) whose month and model no earlier batch has, each once."""
    known = batches(rows.sparkSession, log, rows.schema, batch).select(*LOG_KEYS).distinct()
    fenced(rows.join(known, list(LOG_KEYS), "left_anti").dropDuplicates(["geo", *LOG_KEYS]), log, batch)


class Scorer:
    """Scores logged months once, when they are observed, for one target: its name, sensor and the scores' version."""

    def __init__(self, log: str, folder: str, log_schema: T.StructType, target: dict[str, str], absent_is_zero: bool, reference: float, increase: float):
        self.log, self.log_schema, self.target = log, log_schema, target
        self.seen, self.scores, self.fence = f"{folder}/seen", f"{folder}/scores", f"{folder}/fence"
        self.absent_is_zero, self.limits = absent_is_zero, (reference, increase)

    def _logged(self, spark: SparkSession, batch: int) -> DataFrame:
        """The log as the batch found it the first time."""
        rows, fence = batches(spark, self.log, self.log_schema), f"{self.fence}/batch={batch}"
        if not _there(spark, f"{fence}/_SUCCESS"):
            fenced(rows.agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("last")), self.fence, batch)
        return rows.where(F.col("batch") <= spark.read.schema("last int").parquet(fence).first()["last"])

    def score(self, rows: DataFrame, batch: int) -> None:
        """rows: observed geo, p, y that are new. Forecasts logged after their month was observed are scored with the next batch."""
        spark = rows.sparkSession
        fenced(rows.select("geo", "p", "y").distinct(), self.seen, batch)
        seen = batches(spark, self.seen, rows.select("geo", "p", "y").schema, batch + 1)
        named = self._logged(spark, batch).select("geo", "p", "model", "pred", *[F.lit(v).alias(k) for k, v in self.target.items()])
        result = monitoring.delayed_scores(named, seen, SCORE_KEYS, self.absent_is_zero, *self.limits)
        done = batches(spark, self.scores, result.schema, batch).select(*SCORE_KEYS)
        fenced(result.join(done, list(SCORE_KEYS), "left_anti"), self.scores, batch)

    def scored(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.scores).drop("batch")


def run(stream: DataFrame, each, state: str) -> None:
    """Runs each(rows, batch) over what there is, going on where a run with the same state stopped."""
    stream.writeStream.foreachBatch(lambda rows, batch: each(rows, batch)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def in_files(rows: DataFrame, parts: Sequence, folder: str) -> DataFrame:
    """rows as a stream: one file for each condition of parts, read in this order, a file a batch."""
    for part in parts:
        rows.where(part).coalesce(1).write.mode("append").parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
