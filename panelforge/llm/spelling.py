"""Spelling variants: every word is tied to the far more frequent word one edit away.

Full neighbourhood generation. For each word of the vocabulary all distinct deletions,
replacements and insertions over the observed alphabet are made, and those that stand in the
vocabulary are its near words: a hash join finds them, and no distance is ever computed.

Words hold letters up to U+00FF only, so a block of words of one length is a matrix of bytes,
and the hash of every neighbour follows from sums over the word's prefix and suffix. A word has
about a thousand neighbours, nearly all of which are no words; each task therefore asks bitmaps
of the vocabulary's hashes first and only makes strings of those that may be words. These go
into the join with the vocabulary on the whole string, so wrong bits cost rows and not results.
Bitmaps come in slices of SLICE words at most and blocks of BLOCK words; each block meets each
slice, so nothing that a task holds grows with the vocabulary.

Null and empty texts have no words; a null id counts as an empty string in the damage rule.
Repeated rows count as often as they stand there. Very long texts and runs go in pieces; all
of them count. Ties between forms go to the smallest in code-point order. An empty table gives
an empty result. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import documents, in_slices, step_done, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
DAMAGE, MIN_LENGTH, MIN_COUNT, RATIO = 199, 6, 5, 5
#: Words in a task's memory of counts, in a block and in a slice of the bitmaps; bits a word, probes of a bit each; hashes at once.
HELD, BLOCK, SLICE, BITS, PROBES, AT_ONCE = 200_000, 1 << 15, 1 << 22, 16, 4, 1 << 21
#: Blocks that share a copy of a bitmap in the join that brings them together.
FEW = 16
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(text: str) -> str:
    """Only A-Z in lower case."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def damaged(word: str, key: str) -> str:
    """word without one letter, where the hash of key and word says so."""
    h = zlib.crc32(f"{key}:{word}".encode())
    if h % DAMAGE:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def counted(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n: words of min_length letters and min_count occurrences over all texts.

    Tasks add up in a memory of HELD words and pass it on when it is full.
    """

    def run(batches):
        import pyarrow as pa

        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in in_slices(batches, 1):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for word, n in Counter(RUN.findall(lowered(text))).items():
                    word = damaged(word, key)
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) > HELD:
                    yield flush()
        yield flush()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text").where("text IS NOT NULL")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads sums over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sums(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE, and for each word the sums of letter * BASE ** place over each prefix."""
    n, length = letters.shape
    powers = np.cumprod(np.append(np.uint64(1), np.full(length + 1, BASE)), dtype=np.uint64)
    prefix = np.zeros((n, length + 1), np.uint64)
    np.cumsum(letters.astype(np.uint64) * powers[:length], 1, dtype=np.uint64, out=prefix[:, 1:])
    return powers, prefix


def word_hashes(letters: np.ndarray) -> np.ndarray:
    return mixed(_sums(letters)[1][:, -1])


def by_length(words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of each length, and their letters as a matrix."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = []
    for length in np.unique(sizes):
        places = np.flatnonzero(sizes == length)
        rows = max(1, AT_ONCE // int(length))
        for at in range(0, len(places), rows):
            some = places[at : at + rows]
            out.append((some, np.frombuffer(b"".join(words[i] for i in some), np.uint8).reshape(len(some), length)))
    return out


def neighbours(letters: np.ndarray, alphabet: np.ndarray):
    """Yields hashes of all neighbours of words of one length, with row, kind, place and letter of each.

    Kinds: 0 deletes the letter at the place, 1 replaces it, 2 inserts before it. At most about
    AT_ONCE hashes are made at a time.
    """
    n, length = letters.shape
    powers, prefix = _sums(letters)
    whole = prefix[:, -1]
    a = alphabet.astype(np.uint64)
    step = max(1, AT_ONCE // (n * (len(a) + 1)))
    for lo in range(0, length + 1, step):
        hi = min(lo + step, length + 1)
        end = min(hi, length)
        rest = whole[:, None] - prefix[:, lo:hi]  # from the place on
        added = prefix[:, lo:hi, None] + (powers[lo:hi, None] * a)[None] + (rest * BASE)[:, :, None]
        row, place, k = np.indices(added.shape, np.int32)
        yield mixed(added.ravel()), row.ravel(), 2, place.ravel() + lo, alphabet[k.ravel()]
        if end > lo:
            own = letters[:, lo:end].astype(np.uint64) * powers[lo:end]
            gone = prefix[:, lo:end] + (whole[:, None] - prefix[:, lo + 1 : end + 1]) * INVERSE
            row, place = np.indices(gone.shape, np.int32)
            yield mixed(gone.ravel()), row.ravel(), 0, place.ravel() + lo, np.zeros(gone.size, np.uint8)
            other = (whole[:, None] - own)[:, :, None] + (powers[lo:end, None] * a)[None]
            row, place, k = np.nonzero(letters[:, lo:end, None] != alphabet)
            yield mixed(other[row, place, k]), row, 1, place + lo, alphabet[k]


def edited(word: bytes, kind: int, place: int, letter: int) -> bytes:
    return word[:place] + (b"" if kind == 0 else bytes([letter])) + word[place + (kind < 2) :]


def slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    return (hashes >> np.uint64(40)) % np.uint64(slices)


def _bit(hashes: np.ndarray, probe: int, width: int) -> np.ndarray:
    """A bit's number for each hash; 2 ** width bits. Steps are odd multiples of the hash's upper half."""
    return (hashes + np.uint64(probe) * ((hashes >> np.uint64(32)) | np.uint64(1))) & np.uint64((1 << width) - 1)


def bitmap(hashes: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(1 << (width - 3), np.uint8)
    for p in range(PROBES):
        bits = _bit(hashes, p, width)
        np.bitwise_or.at(out, bits >> np.uint64(3), np.uint8(1) << (bits & np.uint64(7)).astype(np.uint8))
    return out


def maybe(hashes: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    """Places of the hashes that may be in the bitmap."""
    left = np.arange(len(hashes))
    for p in range(PROBES):
        at = _bit(hashes[left], p, width)
        left = left[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return left


def blocks(words: DataFrame, slices: int) -> DataFrame:
    """block, words and hashes: words in Latin-1 by lines, BLOCK at most, and their hashes by slice as 8 bytes each."""

    def run(batches):
        import pyarrow as pa

        def packed(some):
            data = [w.encode("latin-1") for w in some]
            hashes = np.empty(len(data), np.uint64)
            for places, letters in by_length(data):
                hashes[places] = word_hashes(letters)
            of = slice_of(hashes, slices)
            return pa.RecordBatch.from_arrays([pa.array([b"\n".join(data)]), pa.array([[hashes[of == s].tobytes() for s in range(slices)]], pa.list_(pa.binary()))], names=["words", "hashes"])

        waiting, size = [], 0
        for b in in_slices(batches, 0, BLOCK):
            for w in b.column(0).to_pylist():
                waiting.append(w)
                size += len(w)
                if len(waiting) == BLOCK or size > AT_ONCE:
                    yield packed(waiting)
                    waiting, size = [], 0
        if waiting:
            yield packed(waiting)

    return words.select("word").mapInArrow(run, "words binary, hashes array<binary>").withColumn("block", F.monotonically_increasing_id())


def filters(table: DataFrame, width: int) -> DataFrame:
    """slice and bits: a bitmap of each slice's hashes."""

    def run(group):
        import pandas as pd

        hashes = np.frombuffer(b"".join(group["h"]), np.uint64)
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "bits": [bitmap(hashes, width).tobytes()]})

    return table.select(F.posexplode("hashes").alias("slice", "h")).groupBy("slice").applyInPandas(run, "slice int, bits binary")


def candidates(words: DataFrame, letters: str) -> DataFrame:
    """word and near: distinct neighbours of every word over letters, without most of those that are no words."""
    total = words.count()
    slices = max(1, -(-total // SLICE))
    width = max(10, (BITS * -(-max(total, 1) // slices) - 1).bit_length())
    table = written(blocks(words, slices), "blocks")
    maps = written(filters(table, width), "bitmaps")
    alphabet = np.frombuffer(letters.encode("latin-1"), np.uint8)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for data, s, bits in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words, bits = data.split(b"\n"), np.frombuffer(bits, np.uint8)
                for places, rows in by_length(words):
                    found = set()
                    for hashes, row, kind, place, letter in neighbours(rows, alphabet):
                        mine = np.arange(len(hashes)) if slices == 1 else np.flatnonzero(slice_of(hashes, slices) == s)
                        hit = mine[maybe(hashes[mine], bits, width)]
                        own = places[row[hit]]
                        found.update((i, edited(words[i], kind, p, c)) for i, p, c in zip(own.tolist(), place[hit].tolist(), letter[hit].tolist(), strict=True))
                        if len(found) > HELD:  # a place's neighbours are new ones but for repeats, which the join's own distinct takes
                            yield _pairs(pa, words, found)
                            found = set()
                    yield _pairs(pa, words, found)

    # a copy of each bitmap for every FEW blocks or so, so that no task of the join sees all blocks
    tall = table.count()
    copies = 1 + tall // FEW
    numbers = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    asked = table.select("words", F.pmod(F.xxhash64("block"), F.lit(copies)).alias("copy"), numbers(slices, "slice"))
    met = asked.join(maps.select("slice", "bits", numbers(copies, "copy")), ["slice", "copy"]).select("words", "slice", "bits")
    pairs = written(met.repartition(max(tall * slices, 1)).mapInArrow(run, "word string, near string").distinct(), "candidates")
    step_done(table, maps)
    return pairs


def _pairs(pa, words: list[bytes], found: set):
    own, near = [words[i].decode("latin-1") for i, _ in found], [x.decode("latin-1") for _, x in found]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(near, pa.string())], names=["word", "near"])


def near_words(words: DataFrame) -> DataFrame:
    """word, near and n of near, for every two words (word, n) that are one edit apart, both ways."""
    spread = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).where("letter <> ''").distinct()
    letters = "".join(sorted(r[0] for r in spread.collect()))  # at most 116: RUN's letters
    return candidates(words, letters).join(words.select(F.col("word").alias("near"), "n"), "near").select("word", "near", "n")


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("b"))
    far = (-F.col("b.less")) >= ratio * F.col("n")
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("b.near")).alias("form"), F.when(far, -F.col("b.less")).alias("form_n"))
    table = written(joined, "forms")
    up = written(table.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    most = table.agg(F.max("n")).first()[0] or 1
    depth = 0
    while most >= ratio:
        most, depth = most // ratio, depth + 1
    for _ in range(max(depth - 1, 0).bit_length()):  # each form has ratio times the count, so paths are short; each round doubles them
        above = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(up.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        step_done(up)
        up = longer
    return table.join(up, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms(written(counted(documents(spark, sf_dir)), "words")).select("word", "form", "root", "n", "n_near", "form_n")
