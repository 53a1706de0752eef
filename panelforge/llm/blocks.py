"""Blocks of documents and packed messages between blocks and buckets.

A block is one row with many documents' bytes, a few megabytes. What a block asks about all
others goes as packed arrays to buckets by hash, and the answers come back to the block: two
shuffles of few, dense rows in place of one row for each item. Every step is a written table.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import in_slices, quoted, written

BLOCK_BYTES, MOST_BYTES = 1 << 20, 16 << 20
#: Messages a BLOCK_BYTES of text, where blocks and buckets grow.
DENSITY = 64
LAST = np.iinfo(np.int64).max
MESSAGE = "block bigint, bucket bigint, kind int, body binary"


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; the first bytes of all items come first, then their second ones."""
    parts = [struct.pack("<B", len(arrays))]
    for a in map(np.ascontiguousarray, arrays):
        parts += [struct.pack("<3sQ", a.dtype.str.encode(), len(a)), a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def load(body: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(body), 1, []
    for _ in range(data[0]):
        kind, n = struct.unpack_from("<3sQ", data, at)
        dtype = np.dtype(kind.decode())
        planes = np.frombuffer(data, np.uint8, n * dtype.itemsize, at + 11).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).ravel())
        at += 11 + planes.size
    return out


def dump_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit values as steps of the fewest whole bytes."""
    steps = np.diff(values, prepend=values[:1])
    wide = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(values) else 1
    return struct.pack("<QB", int(values[0]) if len(values) else 0, wide) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def load_sorted(data: bytes) -> np.ndarray:
    first, wide = struct.unpack_from("<QB", data)
    bytes_ = np.frombuffer(data, np.uint8, offset=9).reshape(wide, -1)
    full = np.zeros((bytes_.shape[1], 8), np.uint8)
    full[:, :wide] = bytes_.T
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64) + np.uint64(first)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct values, a place where each stands, and each item's place among them."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    back = np.empty(len(values), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], order[new], back


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of equal stretches of the 64-bit range, so sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Stretches of equal, ascending buckets."""
    edges = np.flatnonzero(np.diff(buckets, prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(buckets[a]), slice(a, b)


class Block:
    """One block's documents: ids, bodies end to end, and where each ends."""

    def __init__(self, number: int, ids: list, sizes: list, body: bytes):
        self.number, self.ids = number, list(ids)
        self.order = np.array([LAST if i is None else i for i in self.ids], np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = zstandard.decompress(body)


def grown_bytes(total: int) -> int:
    """Bytes of a block or bucket of total bytes of text.

    Every block writes to every bucket, so with a fixed size messages grow with the square of the
    text. Sizes that grow with its root keep them in proportion to it, up to MOST_BYTES.
    """
    return min(MOST_BYTES, max(BLOCK_BYTES, math.isqrt(total * BLOCK_BYTES // DENSITY)))


def blocks(df: DataFrame, key: str = "doc_id", text: str = "text", prepare: Callable[[bytes], bytes] | None = None, size_limit: int = 0) -> DataFrame:
    """A written table of blocks: block, ids, sizes, body. Null texts are empty."""
    limit = size_limit or BLOCK_BYTES

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        number, ids, parts, size = TaskContext.get().partitionId() << 28, [], [], 0

        def row():
            body = zstandard.compress(b"".join(parts), 3)
            return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([list(map(len, parts))], pa.list_(pa.int64())), "body": pa.array([body], pa.binary())})

        for b in in_slices(batches, 1):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = (t or "").encode()
                ids.append(i)
                parts.append(prepare(data) if prepare else data)
                size += len(parts[-1])
                if size >= limit:
                    yield row()
                    number, ids, parts, size = number + 1, [], [], 0
        if ids:
            yield row()

    rows = df.select(F.col(quoted(key)).cast("bigint").alias("k"), F.col(quoted(text)).alias("t"))
    return written(rows.mapInArrow(run, "block bigint, ids array<bigint>, sizes array<bigint>, body binary"), "blocks")


def _opened(rows: dict) -> Iterator[Block]:
    return (Block(*x) for x in zip(rows["block"], rows["ids"], rows["sizes"], rows["body"], strict=True))


def ask(table: DataFrame, fn: Callable[[Block], Iterator[tuple[int, int, bytes]]], name: str) -> DataFrame:
    """Messages (bucket, kind, body) that fn makes of each block."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in in_slices(batches, 3, 1):
            for block in _opened(b.to_pydict()):
                yield _messages(pa, block.number, fn(block))

    return table.mapInArrow(run, MESSAGE)


def _messages(pa, block: int, rows) -> object:
    bucket, kind, body = zip(*rows, strict=True) if (rows := list(rows)) else ((), (), ())
    return pa.RecordBatch.from_pydict({"block": pa.array([block] * len(body), pa.int64()), "bucket": pa.array(bucket, pa.int64()), "kind": pa.array(kind, pa.int32()), "body": pa.array(body, pa.binary())})


def answer(messages: DataFrame, fn: Callable[[list[bytes]], list[bytes]], kind: int) -> DataFrame:
    """For each bucket, fn turns the messages' bodies, in order of blocks, into as many answers, written as kind."""

    def run(table):
        import pyarrow as pa

        table = table.sort_by("block")
        answers = fn(table.column("body").to_pylist())
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "kind": pa.array([kind] * len(answers), pa.int32()), "body": pa.array(answers, pa.binary())})

    return written(messages.groupBy("bucket").applyInArrow(run, MESSAGE), "answers")


def with_answers(table: DataFrame, answers: DataFrame, fn: Callable[[Block, dict[tuple[int, int], bytes]], object], schema: str) -> DataFrame:
    """fn(block, answers by (kind, bucket)) gives a list of columns for each block."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(left, right):
        import pyarrow as pa

        by = dict(zip(zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist(), strict=True), right.column("body").to_pylist(), strict=True))
        rows = left.to_pydict()
        outs = [fn(block, by) for block in _opened(rows)]
        return pa.table([pa.array([v for o in outs for v in o[i]], kinds.field(i).type) for i in range(len(kinds))], schema=kinds) if outs else kinds.empty_table()

    return table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
