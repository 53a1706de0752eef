"""Encoding, token files and packing against the tokenizers library and brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelforge.llm import bpe, encoding, packing, token_files
from panelforge.llm.encoding import Memory, as_array, library_encoder

from .conftest import AWKWARD

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "<|endoftext|>", "<|startoftext|>", "'s", "é", "é", "1", "23", "日", "　", "\xa0", "!", "...", " the", "ing", "😀", "aaaa", "क़", "Σ", "İ", "."]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text, add_special_tokens=False).ids


LIBRARY = {path: library(path) for path in (BYTES, WORDS)}
CODER = bpe.coder(BYTES)
ENCODERS = [(BYTES, CODER[1]), (BYTES, library_encoder(BYTES, True)), (WORDS, library_encoder(WORDS, False))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
def test_encoders_agree_with_the_library(text):
    for path, ours in ENCODERS:
        assert as_array(ours.ids(text)).tolist() == LIBRARY[path](text)
    assert CODER[0].decode(as_array(CODER[1].ids(text))).decode() == text


def test_one_long_word_is_encoded_whole():
    text = "ab" * 20_000
    assert as_array(CODER[1].ids(text)).tolist() == LIBRARY[BYTES](text)


def test_memory_of_chunks_stays_bounded():
    encoder = CODER[1]
    small = type(encoder)(encoder.encode, True, encoder.loose, encoder.special, limit=10)
    text = " ".join(f"w{i}" for i in range(50)) + " w1 w2"
    assert small.ids(text) == encoder.ids(text)


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 32])
def test_packed_ids_come_back(bits):
    ids = np.random.default_rng(1).integers(0, 1 << bits, 1000, dtype=np.uint64).astype("<u4")
    assert (token_files.unpack(token_files.pack(ids, bits), 1000, bits) == ids).all()


def test_token_file_random_access(tmp_path):
    path, rng = str(tmp_path / "x.bin"), np.random.default_rng(2)
    ids = rng.integers(0, 5000, 100_000).astype("<u4")
    writer = token_files.TokenWriter(path, 13)
    for part in np.array_split(ids, 37):
        writer.add(part)
    writer.close()
    reader = token_files.TokenReader(path)
    for a, b in [(0, 0), (0, 1), (99_999, 100_000), (32_767, 32_769), (5, 90_000), (0, 100_000)]:
        assert (reader.ids(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        reader.ids(0, 100_001)


def test_op3(spark, awkward, empty):
    encode = library(BYTES)
    want = sorted(((d, len(i := encode(t or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _, _ in AWKWARD), key=str)
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op3_bpe(spark, awkward).collect()]
    assert sorted(got, key=str) == want
    assert bpe.op3_bpe(spark, empty).count() == 0


def test_op3_has_one_python_step(spark, awkward):
    """Of two in a row, workers swap, and each lets go the other's tables."""
    plan = bpe.op3_bpe(spark, awkward)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_op5(spark, awkward, empty):
    encode, at, want = library(WORDS), 0, []
    for d, t, _, _ in sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*encode(t or ""), 1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.op5_token_files(spark, awkward).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_files.op5_token_files(spark, empty).count() == 0


def test_op5_takes_chunks_without_ids(spark, save):
    encode, at, want = library(WORDS), 0, []
    texts = [" ", "\t", " \n ", "\n word", "word \n word", "\n", "\u3000"]
    for d, t in enumerate(texts):
        ids = [*encode(t), 1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    folder = save([(d, t, "en", "s") for d, t in enumerate(texts)])
    got = [tuple(r) for r in token_files.op5_token_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == want


def test_op6(spark, awkward, empty):
    encode = library(BYTES)
    rows = packing.op6_packing(spark, awkward).collect()
    want = []
    for d, t, _, _ in AWKWARD:
        ids = np.array([*encode(t or ""), 0], "<u4")
        n, at, k = len(ids), 0, 0
        while at < n:
            step = n if n <= 2048 else (n - at) % 2048 or 2048
            want.append((d, k, at, step, zlib.crc32(ids[at : at + step].tobytes())))
            at, k = at + step, k + 1
    assert sorted([tuple(r[:5]) for r in rows], key=str) == sorted(want, key=str)
    gapless([(r.sequence_id, r.offset, r.length) for r in rows], 2048)
    assert packing.op6_packing(spark, empty).count() == 0


def gapless(rows, capacity):
    bins = defaultdict(list)
    for b, offset, length in rows:
        bins[b].append((offset, length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 2048])
    lengths = [rng.randint(1, capacity) for _ in range(600)]
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    rows = []
    for length, lo, hi, each, first, offset in packing.plan(counts, capacity):
        rows += [(first + (r - lo) // each, offset + (r - lo) % each * length, length) for r in range(lo, hi)]
    assert sorted(r[2] for r in rows) == sorted(lengths)
    assert gapless(rows, capacity) == best_fit_decreasing(lengths, capacity)


def test_a_worker_without_a_task_lets_go(monkeypatch):
    import time

    from panelforge.llm import common

    monkeypatch.setattr(common, "IDLE_SECONDS", 0.2)
    big = common.lone("big", lambda: [1])
    assert common.lone("big", lambda: [2]) is big
    batches = common.in_slices(iter([pa.record_batch({"x": ["a", "b"]})]), 0, rows=1)
    next(batches)
    time.sleep(0.6)
    assert common.lone("big", lambda: [3]) is big  # its task goes on
    list(batches)
    time.sleep(0.6)
    assert common.lone("big", lambda: [4]) == [4]


def test_memory_keeps_what_is_asked_for():
    memory = Memory(8)
    memory.young.update(a=b"1", b=b"2", c=b"3")
    memory.make_room(1)
    assert memory.lacking({"a", "b", "c"}) == set()
    memory.make_room(2)
    assert memory.lacking({"a", "x"}) == {"x"} and memory.young == {"a": b"1"}
    memory.young.update(p=b"4", q=b"5", r=b"6")
    memory.make_room(1)
    assert memory.lacking({"a", "b", "c"}) == {"b", "c"}


@pytest.mark.parametrize("path,glued", [(BYTES, True), (WORDS, False)])
def test_many_texts_with_a_small_memory_encode_as_the_library(path, glued):
    rng = random.Random(6)
    words = [f"w{i}ord" for i in range(300)] + ["Ab", "ab.", "\u00e9\nAb!", "x\ny"]
    texts = ["", " ", "a  b", "\nAb ab", "<|endoftext|> Ab", *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(200))]
    encoder = library_encoder(path, glued, 100)
    want = [LIBRARY[path](t) for t in texts]
    assert [as_array(i).tolist() for i in encoder.all_ids(texts)] == want == [as_array(encoder.ids(t)).tolist() for t in texts]


@pytest.mark.parametrize("path,glued", [(BYTES, True), (WORDS, False)])
def test_words_with_any_marks_are_not_learned_one_by_one(path, glued):
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]
    words = [f"Wort{m}{n}" for m in marks for n in ["", *marks]]
    text = "a " + " ".join([*words, *(f"{w}\n{w}" for w in words), "it's", "x'", "'ll.", "café's"])
    encoder, sent = encoding._library_encoder(path, glued), []
    encode = encoder.encode
    encoder.encode = lambda chunks: sent.extend(chunks) or encode(chunks)
    assert as_array(encoder.ids(text)).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert not [c for c in sent if "Wort" in c]


def test_pieces_of_one_length_are_ranked_in_many_tasks(spark, monkeypatch):
    stored, written = {}, packing.written

    def kept(df, name):
        stored[name] = written(df, name)
        return stored[name]

    monkeypatch.setattr(packing, "written", kept)
    parts = written(spark.range(30_000).selectExpr("id doc_id", "0 piece", "0L start", "1000L + id % 3 length", "id * 7 ids_crc32"), "one-length")
    rows = packing.packed(parts, 2048).collect()
    assert sorted(r.doc_id for r in rows) == list(range(30_000))
    assert gapless([(r.sequence_id, r.offset, r.length) for r in rows], 2048) == 15_000
    counts = stored["packing-counts"].groupBy("length").count().collect()
    assert len(counts) == 3 and all(r["count"] > 1 for r in counts)
