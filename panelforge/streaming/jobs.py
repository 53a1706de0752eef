"""Structured Streaming twins of the batch ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.sources.tables import new_folder


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as a file stream; times get the zone that watermarks need."""
    schema = spark.read.parquet(path).schema
    pattern = path if path.endswith("/") else path.rsplit("/", 1)[0]
    name = path.rsplit("/", 1)[1]
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name if _is_file(spark, path) else "*.parquet").parquet(pattern if _is_file(spark, path) else path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_file(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()


def monthly(events: DataFrame) -> DataFrame:
    return events.groupBy(F.year("ts").alias("ano"), F.month("ts").alias("mes"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def tumbling(events: DataFrame, width: str, late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def distinct(events: DataFrame, late: str = "60 days") -> DataFrame:
    """Each event id once, as long as repeats come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_complete(stream: DataFrame, name: str) -> DataFrame:
    """Runs over what there is; the last state of the whole result, as Parquet in the shared folder."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession, name)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _folder(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A folder, new if none is given, with a place for rows, there even if nothing arrives."""
    folder = folder or new_folder(spark, name)
    rows = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    rows.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(rows)
    return folder


def run_append(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Runs over what there is; the rows as Parquet in the shared folder, beside the stream's checkpoint.

    With the folder of an earlier run, it goes on where that one stopped.
    """
    spark = stream.sparkSession
    folder = _folder(spark, name, folder)
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
