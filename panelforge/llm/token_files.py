"""Token ids in binary files: fixed-width bit packing with block offsets.

A file is a header, blocks of BLOCK ids with every id in the fewest bits that hold the
vocabulary, the offset of each block, and a footer that says where the offsets are. A range
of ids is read by unpacking only its blocks, with numpy.

Tasks write files into the shared folder under names of their own attempt; only the rows of
attempts that succeed name files, so a lost executor leaves at most an unnamed file behind.

Documents are in ascending id order, null ids first, repeated ids by the hash of their text.
Null text is empty and has only the end id. An empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.common import documents, fresh_path, in_slices, qualified, quoted, written
from panelforge.llm.encoding import ROOMY, as_array, library_encoder

VOCABULARY, VOCABULARY_SIZE, END = "word_bpe_49k.json", 49_408, 1
MAGIC, BLOCK, FILE_IDS = b"PFTOKEN1", 1 << 15, 1 << 22
_FOOTER = struct.Struct("<QQQ8s")


def width(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype("<u2").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype("<u4")
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def _place(path: str):
    """The file system and its path. Paths have the scheme by which Spark found them."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)


class TokenWriter:
    """Writes one file; close() gives it its footer."""

    def __init__(self, path: str, bits: int):
        system, name = _place(path)
        self.path, self.bits, self.n, self.offsets, self.held = path, bits, 0, [], []
        self.waiting = 0
        self.out = system.open_output_stream(name)
        head = json.dumps({"bits": bits, "block": BLOCK}).encode()
        self.out.write(MAGIC + struct.pack("<I", len(head)) + head)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        stop = len(ids) if last else len(ids) // BLOCK * BLOCK
        for at in range(0, stop, BLOCK):
            self.offsets.append(self.out.tell())
            self.out.write(pack(ids[at : min(at + BLOCK, stop)], self.bits))
        self.held, self.waiting = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        at = self.out.tell()
        self.out.write(np.array(self.offsets, "<u8").tobytes() + _FOOTER.pack(at, len(self.offsets), self.n, MAGIC))
        self.out.close()


class TokenReader:
    """Random access to one file's ids."""

    def __init__(self, path: str):
        system, name = _place(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(_FOOTER.size, size - _FOOTER.size)
        at, blocks, self.n, magic = _FOOTER.unpack(tail)
        if magic != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"not a token file: {path}")
        length = struct.unpack("<I", self.file.read_at(4, 8))[0]
        head = json.loads(self.file.read_at(length, 12))
        self.bits, self.block = head["bits"], head["block"]
        self.offsets = [*np.frombuffer(self.file.read_at(8 * blocks, at), "<u8").tolist(), at]
        self.held: tuple[int, int, np.ndarray] = (0, 0, np.zeros(0, "<u4"))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop; blocks just read are kept, so reading in order reads each once."""
        if not 0 <= start <= stop <= self.n:
            raise IndexError((start, stop, self.n))
        if start == stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block + 1
        if (first, last) != self.held[:2]:
            parts = []
            data = self.file.read_at(self.offsets[last] - self.offsets[first], self.offsets[first])
            for k in range(first, last):
                n = min(self.block, self.n - k * self.block)
                parts.append(unpack(data[self.offsets[k] - self.offsets[first] : self.offsets[k + 1] - self.offsets[first]], n, self.bits))
            self.held = (first, last, np.concatenate(parts))
        base = first * self.block
        return self.held[2][start - base : stop - base]


def write_files(df: DataFrame, vocabulary: str, vocabulary_size: int, end: int | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of all texts in key order; the index: key, file, part, first, n_tokens.

    first: the document's place in its file. part: orders the files.
    """
    spark = df.sparkSession
    folder = qualified(spark, fresh_path(spark, "tokens"))
    spark.createDataFrame([(vocabulary_size,)], "vocabulary_size int").coalesce(1).write.parquet(f"{folder}/about")  # makes the folder
    bits = width(vocabulary_size)
    key_field = T.StructField("k", df.schema[key].dataType)
    schema = T.StructType([key_field, *T.StructType.fromDDL("part bigint, file string, first bigint, n_tokens bigint").fields])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = library_encoder(vocabulary, False, ROOMY)
        tail = b"" if end is None else struct.pack("<I", end)
        partition, roll, writer = TaskContext.get().partitionId(), 0, None
        for b in in_slices(batches, 1):
            out: list[tuple] = []
            for found in encoder.all_ids([t or "" for t in b.column(1).to_pylist()]):
                if writer is None or writer.n >= FILE_IDS:
                    if writer:
                        writer.close()
                    roll += 1
                    writer = TokenWriter(f"{folder}/part-{partition:07d}-{roll:05d}-{uuid.uuid4().hex}.bin", bits)
                ids = as_array(found + tail)
                out.append(((partition << 24) + roll, writer.path, writer.n, len(ids)))
                writer.add(ids)
            part, file, first, n = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(part, pa.int64()), pa.array(file, pa.string()), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=["k", "part", "file", "first", "n_tokens"])
        if writer:
            writer.close()

    rows = df.select(F.col(quoted(key)).alias("k"), F.col(quoted(text)).alias("t"), F.xxhash64(F.col(quoted(text))).alias("h"))
    ordered = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h").select("k", "t")
    return written(ordered.mapInArrow(run, schema), "token-index").withColumnRenamed("k", key)


def with_starts(index: DataFrame) -> DataFrame:
    """index with start: the ids of all documents before.

    Files are summed within the task that wrote them; only one sum for each task meets in one place.
    """
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("task", F.shiftright("part", 24))
    back = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tasks = files.groupBy("task").agg(F.sum("n").alias("n"))
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(back(Window.orderBy("task"))), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n").over(back(Window.partitionBy("task").orderBy("part"))), F.lit(0))
    sums = files.withColumn("within", within).join(tasks, "task").select("part", (F.col("base") + F.col("within")).alias("before"))
    return index.join(sums, "part").withColumn("start", F.col("before") + F.col("first")).drop("before")


def read_back(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and ids_crc32 of every document, from the files."""
    kind = index.schema[key].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        reader, rows = TokenReader(rows["file"].iloc[0]), rows.sort_values("first", kind="stable")
        found = [reader.ids(a, a + n) for a, n in zip(rows["first"], rows["n_tokens"], strict=True)]
        return pd.DataFrame({"k": rows["k"], "start": rows["start"], "n_tokens": [len(i) for i in found], "ids_crc32": [zlib.crc32(i.tobytes()) for i in found]})

    placed = with_starts(index).select(F.col(quoted(key)).cast("string").alias("k"), "file", "first", "n_tokens", "start")
    read = placed.groupBy("file").applyInPandas(run, "k string, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read.withColumn("k", F.col("k").cast(kind)).withColumnRenamed("k", key)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_files(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), VOCABULARY_SIZE, END)
    return read_back(index)
