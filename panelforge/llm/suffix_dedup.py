"""Exact removal of repeated byte strings by prefix-free parsing.

A rolling hash of TRIGGER bytes runs over each text. In every stretch of LENGTH bytes the
least hash is its trigger, so equal stretches have equal triggers wherever they stand.
Stretches that follow each other with one trigger form a phrase, at most PHRASE of them, kept
with the bytes that its last stretch reaches. Triggers that one document alone has need no
more work. Of the others, each block sends its distinct phrases with the least document that
has them: the dictionary. Its suffixes are sorted by doubling ranks up to LENGTH bytes, which
is their order in the corpus as far as it matters; equal neighbours give the least document
of every stretch. The parse, which phrase stands where, stays in the blocks and takes the
answers back to places.

Blocks and buckets grow with the root of the text, as every block writes to every bucket. A
bucket is worked off in parts of PHRASE_BUCKET_BYTES of text, so memory doesn't grow with it.

A trigger that more than HOT documents have would gather too many phrases in one bucket; its
stretches go to buckets by their own hash instead.

Null text is empty. A null id counts as after all ids. Rows with one id don't take from each
other. Texts under LENGTH bytes keep all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.blocks import LAST, MESSAGE, Block, answer, ask, blocks, bucket_of, by_bucket, dump, dump_sorted, grown_bytes, load, load_sorted, with_answers
from panelforge.llm.common import documents, quoted, step_done, written
from panelforge.llm.words import distinct

LENGTH, TRIGGER, PHRASE, HOT = 50, 16, 64, 50_000
PIECE = 1 << 20  # bytes that are hashed at once
TRIGGER_BUCKET_BYTES, PHRASE_BUCKET_BYTES = 16 << 20, 1 << 20
ONE, REPEATED, CROWDED = 0, 1, 2


def rolling(data: bytes) -> np.ndarray:
    """Hashes of all strings of TRIGGER bytes; TRIGGER is a power of 2."""
    h = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    factor, n = np.array([0x9E3779B97F4A7C15], np.uint64), 1
    while n < TRIGGER:
        h = h[:-n] * factor + h[n:]
        factor, n = factor * factor, 2 * n
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def triggers(data: bytes, length: int) -> np.ndarray:
    """The least hash in each stretch of length bytes."""
    low, wide, n = rolling(data), length - TRIGGER + 1, 1
    while 2 * n <= wide:
        low, n = np.minimum(low[:-n], low[n:]), 2 * n
    if n < wide:
        low = np.minimum(low[: len(low) - (wide - n)], low[wide - n :])
    return low


def _spread(low: np.ndarray) -> np.ndarray:
    """Least hashes lie at the low end of the hash range; this deals them over all of it, one to one."""
    out = low * np.uint64(0x94D049BB133111EB)
    return (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


class Phrases:
    """A block's phrases: first stretch, number of stretches, trigger, and document."""

    def __init__(self, block: Block, length: int):
        empty = np.zeros(0, np.int64)
        found = [(empty, empty, empty, np.zeros(0, np.uint64))]
        places = len(block.data) - length + 1
        for start in range(0, places, PIECE):
            found.append(self._of(block, length, start, min(start + PIECE, places)))
        self.at, self.n, self.doc, self.trigger = map(np.concatenate, zip(*found, strict=True))

    @staticmethod
    def _of(block: Block, length: int, start: int, stop: int) -> tuple[np.ndarray, ...]:
        """Those of the stretches that begin at start or later and before stop."""
        low = triggers(block.data[start : stop + length - 1], length)
        a, b = np.searchsorted(block.ends, start, "right"), np.searchsorted(block.starts, stop)
        doc = np.repeat(np.arange(a, b), np.minimum(block.ends[a:b], stop) - np.maximum(block.starts[a:b], start))
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        ends = np.append(first[1:], len(low)) + start
        doc, low, first = doc[first], low[first], first + start
        inside = first + length <= block.ends[doc]
        doc, low, first, ends = doc[inside], low[inside], first[inside], ends[inside]
        ends = np.minimum(ends, block.ends[doc] - length + 1)
        cuts = (ends - first + PHRASE - 1) // PHRASE
        step = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        at = np.repeat(first, cuts) + step * PHRASE
        return at, np.minimum(np.repeat(ends, cuts) - at, PHRASE), np.repeat(doc, cuts), np.repeat(_spread(low), cuts)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct triggers in order, the documents that have each (two count as many), and each phrase's trigger."""
        values, back = np.unique(self.trigger, return_inverse=True)
        pairs = distinct(back.astype(np.int64) << 32 | self.doc)
        return values, np.bincount(pairs >> 32, minlength=len(values)), back


def _classify(bodies: list[bytes]) -> list[bytes]:
    """For every block's triggers: in ONE document, REPEATED, or CROWDED."""
    parts = [load(b) for b in bodies]
    values = [load_sorted(p[0].tobytes()) for p in parts]
    found, back = np.unique(np.concatenate(values), return_inverse=True)
    total = np.bincount(back, np.concatenate([p[1] for p in parts]), minlength=len(found))
    kind = np.where(total > HOT, CROWDED, np.where(total > 1, REPEATED, ONE)).astype(np.uint8)[back]
    return [dump(k) for k in np.split(kind, np.cumsum([len(v) for v in values])[:-1])]


class Dictionary:
    """The distinct phrases that a block asks about, by bucket and its parts and there in the order of their first places."""

    def __init__(self, block: Block, length: int, kinds: dict[int, bytes], trigger_buckets: int, parts: int, of_bucket: int):
        p = Phrases(block, length)
        values, _, back = p.distinct()
        kind = np.zeros(len(values), np.uint8)
        for bucket, part in by_bucket(bucket_of(values, trigger_buckets)):
            kind[part] = load(kinds[bucket])[0]
        kind = kind[back]
        common = np.flatnonzero(kind == REPEATED)
        at, n, doc, where = p.at[common], p.n[common], p.doc[common], bucket_of(p.trigger[common], parts)
        crowded = np.flatnonzero(kind == CROWDED)
        if len(crowded):
            step = p.n[crowded]
            single = np.repeat(p.at[crowded] - (np.cumsum(step) - step), step) + np.arange(step.sum())
            hashes = np.array([xxhash.xxh3_64_intdigest(block.data[i : i + length]) for i in single.tolist()], np.uint64)
            at, n, doc = np.concatenate([at, single]), np.concatenate([n, np.ones(len(single), np.int64)]), np.concatenate([doc, np.repeat(p.doc[crowded], step)])
            where = np.concatenate([where, bucket_of(hashes, parts)])
        order = np.argsort(where, kind="stable")
        where = where[order]
        self.at, self.n, self.doc, self.bucket = at[order], n[order], doc[order], where // of_bucket
        #: Of each place, its phrase's number in the bucket.
        self.number = np.zeros(len(self.at), np.int64)
        #: For each bucket its phrases end to end, their sizes and least documents, and how many each part has.
        self.messages: list[tuple[int, bytes]] = []
        ids = block.order[self.doc]
        for bucket, part in by_bucket(self.bucket):
            seen: dict[bytes, int] = {}
            spans = zip(self.at[part].tolist(), (self.at[part] + self.n[part] + length - 1).tolist(), strict=True)
            number = np.array([seen.setdefault(block.data[a:b], len(seen)) for a, b in spans], np.int64)
            least = np.full(len(seen), LAST, np.int64)
            np.minimum.at(least, number, ids[part])
            self.number[part] = number
            first = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1))
            each = np.bincount(where[part][first] - bucket * of_bucket, minlength=of_bucket)
            self.messages.append((bucket, dump(np.frombuffer(b"".join(seen), np.uint8), np.array(list(map(len, seen)), np.uint16), least, each.astype(np.uint32))))


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Place of each key among the distinct ones, in few temporary arrays."""
    order = np.argsort(keys)
    keys = keys[order]
    rank = np.zeros(len(keys), np.int32)
    np.cumsum(keys[1:] != keys[:-1], dtype=np.int32, out=rank[1:])
    out = np.empty_like(rank)
    out[order] = rank
    return out


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the suffix at each place among all, by its first length bytes; places whose stretch ends after the data are left out.

    Ranks of n bytes give ranks of 2 n, and two that overlap give any length.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(len(data), np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + len(data)]
    rank, n = _ranks(key), 8
    del key, padded
    while n < length:
        step = min(n, length - n)
        both = rank[:-step].astype(np.int64) * (int(rank.max()) + 1) + rank[step:] if len(rank) > step else rank[:0]
        if not len(both):
            return both
        rank, n = _ranks(both), n + step
    return rank[: max(0, len(data) - length + 1)]


def _owners(known: list[bytes], first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least document of each stretch of distinct phrases, whose own least documents are first: runs' lengths and documents, and runs a phrase.

    A phrase that has its trigger alone shares no stretch with others; only the rest is sorted.
    """
    sizes = np.array(list(map(len, known)), np.int64)
    trigger = triggers(b"".join(known), length)[np.cumsum(sizes) - sizes]
    _, back, often = np.unique(trigger, return_inverse=True, return_counts=True)
    some = np.flatnonzero(often[back] > 1)
    each, alone = np.ones(len(known), np.int64), np.ones(len(known), bool)
    alone[some] = False
    found = _sorted_owners([known[i] for i in some.tolist()], first[some], length) if len(some) else None
    if found:
        each[some] = found[2]
    at = np.cumsum(each) - each
    runs, least = np.zeros(each.sum(), np.int64), np.zeros(each.sum(), np.int64)
    runs[at[alone]], least[at[alone]] = sizes[alone] - length + 1, first[alone]
    if found:
        c = each[some]
        places = np.repeat(at[some] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        runs[places], least[places] = found[:2]
    return runs, least, each


def _sorted_owners(known: list[bytes], first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for phrases that may share stretches."""
    sizes = np.array(list(map(len, known)), np.int64)
    data = np.frombuffer(b"".join(known), np.uint8)
    starts = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    offsets = np.cumsum(count) - count
    places = np.repeat(starts - offsets, count) + np.arange(count.sum())
    rank = suffix_ranks(data, length)[places]
    owner = np.full(int(rank.max()) + 1, LAST, np.int64)
    np.minimum.at(owner, rank, np.repeat(first, count))
    least = owner[rank]
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    new[offsets] = True
    at = np.flatnonzero(new)
    return np.diff(at, append=len(least)), least[at], np.add.reduceat(new, offsets, dtype=np.int64)


def _least(bodies: list[bytes], length: int) -> list[bytes]:
    """For every block's phrases: the least document of each stretch, as runs (length, document)."""
    parts = [load(b) for b in bodies]
    raw = b"".join(p[0].tobytes() for p in parts)
    sizes, ids = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 2))
    part = np.concatenate([np.repeat(np.arange(len(p[3])), p[3]) for p in parts])
    edges = np.cumsum([len(p[1]) for p in parts])[:-1]
    del parts
    ends = np.cumsum(sizes)
    order, number, owners = np.argsort(part, kind="stable"), np.zeros(len(sizes), np.int64), []
    phrases = 0
    for _, some in by_bucket(part[order]):
        these = order[some]
        known: dict[bytes, int] = {}
        spans = zip((ends[these] - sizes[these]).tolist(), ends[these].tolist(), strict=True)
        own = np.array([known.setdefault(raw[a:b], len(known)) for a, b in spans], np.int64)
        first = np.full(len(known), LAST, np.int64)
        np.minimum.at(first, own, ids[these])
        number[these] = own + phrases
        phrases += len(known)
        owners.append(_owners(list(known), first, length))
    runs, least, each = map(np.concatenate, zip(*owners, strict=True))
    offsets = np.cumsum(each) - each
    out = []
    for n in np.split(number, edges):
        c = each[n]
        at = np.repeat(offsets[n] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        values = least[at]
        new = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        out.append(dump(np.add.reduceat(runs[at], new).astype(np.uint32), values[new]))
    return out


def _kept(block: Block, answers: dict[tuple[int, int], bytes], length: int) -> list[list]:
    place, n, doc, numbers, buckets = load(answers[9, -1])
    removed = np.zeros(len(block.data) + 1, bool)  # stretches, each by its first place + 1
    ids = block.order[doc]
    for bucket, part in by_bucket(buckets):
        runs, values = load(answers[2, bucket])
        flat, number, c = np.repeat(values, runs), numbers[part], n[part]
        count = np.zeros(int(number.max()) + 1, np.int64)
        count[number] = c
        offsets = np.cumsum(count) - count
        step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        earlier = flat[np.repeat(offsets[number], c) + step] < np.repeat(ids[part], c)
        removed[(np.repeat(place[part], c) + step)[earlier] + 1] = True
    before = np.cumsum(removed, dtype=np.int64 if len(removed) >> 31 else np.int32)
    gone = before[1:] > 0
    gone[length:] = before[length + 1 :] > before[1 : max(1, len(before) - length)]
    data = np.frombuffer(block.data, np.uint8)
    out: list[list] = [block.ids, block.sizes.tolist(), [], [], [], []]
    for a, b in zip(block.starts.tolist(), block.ends.tolist(), strict=True):
        g = gone[a:b]
        out[2].append(int(g.sum()))
        out[3].append(int((g[1:] & ~g[:-1]).sum()) + int(len(g) > 0 and g[0]))
        out[4].append(data[a:b][~g].tobytes())
        out[5].append(int.from_bytes(xxhash.xxh64(block.data[a:b], 42).digest(), "big", signed=True))
    return out


def deduplicated(df: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept (the bytes that stay) and text_hash (Spark's xxhash64 of the text) of every row."""
    total = df.select(F.sum(F.octet_length(quoted(text)))).first()[0] or 0
    table = blocks(df, key, text, size_limit=grown_bytes(total))
    tb, parts = max(1, total // TRIGGER_BUCKET_BYTES), max(1, total // PHRASE_BUCKET_BYTES)
    of_bucket = max(1, grown_bytes(total) // PHRASE_BUCKET_BYTES)

    def ask_triggers(block: Block) -> Iterator[tuple[int, int, bytes]]:
        values, docs, _ = Phrases(block, length).distinct()
        for bucket, part in by_bucket(bucket_of(values, tb)):
            yield bucket, 1, dump(np.frombuffer(dump_sorted(values[part]), np.uint8), docs[part].astype(np.uint32))

    kinds = answer(ask(table, ask_triggers, "triggers"), _classify, 1)

    def ask_phrases(block: Block, answers: dict[tuple[int, int], bytes]) -> list[list]:
        d = Dictionary(block, length, {bucket: body for (_, bucket), body in answers.items()}, tb, parts, of_bucket)
        rows = [(bucket, 2, body) for bucket, body in d.messages]
        rows.append((-1, 9, dump(d.at, d.n, d.doc, d.number, d.bucket)))
        return [[block.number] * len(rows), *map(list, zip(*rows, strict=True))]

    asked = written(with_answers(table, kinds, ask_phrases, MESSAGE), "phrases")
    step_done(kinds)
    least = answer(asked.where("kind = 2"), lambda bodies: _least(bodies, length), 2)
    both = least.unionByName(asked.where("kind = 9"))
    kept = with_answers(table, both, lambda block, answers: _kept(block, answers, length), "k bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, text_hash bigint")
    return kept.withColumn("k", F.col("k").cast(df.schema[key].dataType)).withColumnRenamed("k", key)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = deduplicated(documents(spark, sf_dir))
    return table.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
