"""What the operators of this subpackage share: shared-folder tables and null rules."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: Tables written on the way to a concluded one.
_on_the_way: ContextVar[list | None] = ContextVar("_on_the_way", default=None)
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is named and all run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of the file system that Spark takes it for."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later stages read files, not lineage on executors.

    The shuffle files of the job go when it has ended, as nothing reads them again, and Arrow
    batches are small in it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = {k: spark.conf.get(k) for k in _WHILE_WRITING}
    try:
        for k, v in _WHILE_WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    if (others := _on_the_way.get()) is not None:
        others.append(table)
    return table


def concluded(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s rows as a written table; the tables that make() wrote on the way are deleted."""
    before = _on_the_way.set([])
    try:
        result = written(make(), name)
        step_done(*(t for t in _on_the_way.get() if t is not result))
    finally:
        _on_the_way.reset(before)
    if (others := _on_the_way.get()) is not None:
        others.append(result)
    return result


def step_done(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Seconds after which a worker without a task lets go what it holds.
IDLE_SECONDS = 2.0
_held: dict[str, object] = {}
_use = {"tasks": 0, "last": 0.0, "watched": False}


def lone(name: str, make: Callable[[], object]) -> object:
    """The one large object that a Python worker holds; making another lets the last one go first.

    Spark keeps workers without a task for a minute, and the steps after may have no Python, so
    what they hold goes after IDLE_SECONDS.
    """
    if (found := _held.get(name)) is None:
        _held.clear()
        give_back()
        found = _held[name] = make()
    _use["last"] = time.monotonic()
    if not _use["watched"]:
        _use["watched"] = True
        threading.Thread(target=_watch, daemon=True).start()
    return found


def _watch() -> None:
    while _held:
        time.sleep(IDLE_SECONDS / 4)
        if not _use["tasks"] and time.monotonic() - _use["last"] > IDLE_SECONDS:
            _held.clear()
            give_back()
    _use["watched"] = False


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def in_slices(batches: Iterator, column: int, rows: int = 512, size: int = 4 << 20) -> Iterator:
    """Batches cut so that the column's values take about size bytes in each, and memory given back at the task's end."""
    _use["tasks"] += 1
    try:
        for b in batches:
            step = max(1, min(rows, b.num_rows * size // max(b.column(column).nbytes, 1)))
            for at in range(0, b.num_rows, step):
                yield b.slice(at, step)
    finally:
        _use["tasks"] -= 1
        _use["last"] = time.monotonic()
        give_back()


def remainder(doc_id: str, mod: int):
    """crc32 of the id's decimal text, modulo mod; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(mod)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def map_values(df: DataFrame, keep: Sequence[str], value: str, columns: str, fn: Callable[[list], list[list]]) -> DataFrame:
    """The columns keep, as they are, and the columns that fn makes from lists of values.

    fn runs on Arrow batches; keep's values never become Python objects.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    made = T.StructType.fromDDL(columns)
    schema = T.StructType([df.schema[k] for k in keep] + made.fields)
    types, n = to_arrow_schema(made).types, len(keep)
    names = [f"c{i}" for i in range(n)]
    inner = df.select(*[F.col(quoted(k)).alias(c) for k, c in zip(keep, names, strict=True)], F.col(quoted(value)).alias("v"))

    def run(batches):
        import pyarrow as pa

        for b in in_slices(batches, n):
            out = fn(b.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(o, t) for o, t in zip(out, types, strict=True))], names=schema.names)

    return inner.mapInArrow(run, schema)
