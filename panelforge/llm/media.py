"""Media columns: texts' bytes as PNG images in a binary column, read back and hashed.

The bytes, padded to whole rows, are the samples of an 8-bit grey image. Writing picks a
filter for each row; reading tests every chunk's checksum, inflates, and takes the filters
off with numpy. The feature is a hash of the signs of low-frequency cosine coefficients.

Null text is empty: one row of padding. Equal texts give equal files and features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from panelforge.llm.common import documents, map_values, written

ROW, PAD, SIDE, LOW, LEVEL = 576, 255, 32, 8, 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes([PAD]) * (-len(data) % ROW if data else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(samples: np.ndarray) -> bytes:
    """An 8-bit grey image. Each row takes the filter (none, left, up) of the least sum of sizes."""
    height, wide = samples.shape
    left = samples.copy()
    left[:, 1:] -= samples[:, :-1]
    up = samples.copy()
    up[1:] -= samples[:-1]
    options = np.stack([samples, left, up])
    cost = np.minimum(options, 0 - options).sum(2, dtype=np.int64)
    best = cost.argmin(0)
    lines = np.empty((height, wide + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = options[best, np.arange(height)]
    head = struct.pack(">IIBBBBB", wide, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey image, height by width; a ValueError says what is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, size, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        length, kind = struct.unpack_from(">I4s", data, at)
        content = data[at + 8 : at + 8 + length]
        if len(content) < length or data[at + 8 + length : at + 12 + length] != struct.pack(">I", zlib.crc32(kind + content)):
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        ended = kind == b"IEND"
        at += 12 + length
    if not ended or size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit grey image")
    wide, height = size[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) != height * (wide + 1):
        raise ValueError("wrong number of samples")
    lines = raw.reshape(height, wide + 1)
    return unfiltered(lines[:, 0], lines[:, 1:])


def unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Runs of rows with one filter are summed at once; the two that need both neighbours go byte by byte."""
    out = np.empty_like(lines)
    starts = np.flatnonzero(np.diff(kinds, prepend=255)) if len(kinds) else []
    above = np.zeros(lines.shape[1], np.uint8)
    for a, b in zip(starts, [*starts[1:], len(kinds)], strict=True):
        kind = kinds[a]
        if kind == 0:
            out[a:b] = lines[a:b]
        elif kind == 1:
            np.cumsum(lines[a:b], 1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            np.cumsum(lines[a:b], 0, dtype=np.uint8, out=out[a:b])
            out[a:b] += above
        elif kind in (3, 4):
            for y in range(a, b):
                out[y] = _both(kind, lines[y].tolist(), above.tolist())
                above = out[y]
        else:
            raise ValueError(f"unknown filter {kind}")
        above = out[b - 1]
    return out


def _both(kind: int, line: list[int], above: list[int]) -> list[int]:
    left = corner = 0
    row = []
    for x, up in zip(line, above, strict=True):
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
        left, corner = (x + guess) & 255, up
        row.append(left)
    return row


@lru_cache(1)
def _cosines() -> np.ndarray:
    k, x = np.arange(LOW + 1)[:, None], np.arange(SIDE)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


def _shrunk(samples: np.ndarray, axis: int) -> np.ndarray:
    """SIDE means of equal stretches along the axis; short axes repeat samples."""
    n = samples.shape[axis]
    edges = np.arange(SIDE) * n // SIDE
    sizes = np.maximum(np.diff(np.append(edges, n)), 1)
    if n < SIDE:
        return samples.take(edges, axis)
    return np.add.reduceat(samples, edges, axis) / (sizes[:, None] if axis == 0 else sizes)


def feature(samples: np.ndarray) -> str:
    """64 bits in hex: which of the LOW x LOW lowest cosine coefficients but the mean are above their median."""
    small = _shrunk(_shrunk(samples.astype(np.float64), 0), 1)
    c = _cosines()
    low = np.round((c @ small @ c.T)[:LOW, 1 : LOW + 1], 6).ravel()
    return np.packbits(low > np.median(low)).tobytes().hex()


def stored(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and media: a table with the texts as PNG files in a binary column."""

    def run(texts: list) -> list[list]:
        bodies = [payload(t) for t in texts]
        return [[len((t or "").encode()) for t in texts], [write_png(np.frombuffer(b, np.uint8).reshape(-1, ROW)) for b in bodies]]

    return map_values(df, [key], text, "n_bytes bigint, media binary", run)


def examined(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the stored files hold: the payload's size and digests, the file's, and the feature."""

    def run(media: list) -> list[list]:
        out = []
        for m in media:
            samples = read_png(m)
            body = samples.tobytes()
            out.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(samples)))
        return [list(c) for c in zip(*out, strict=True)] if out else [[]] * 6

    return map_values(table, [key, "n_bytes"], "media", "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", run)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examined(written(stored(documents(spark, sf_dir)), "media"))
