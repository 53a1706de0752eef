"""Operators on whole documents against brute force."""

import collections
import hashlib
import itertools
import math
import pickle
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import blocks, graph, jaccard, katz, langid, media, pii, quality, suffix_dedup
from panelforge.llm.queries import QUERIES

from .conftest import AWKWARD
from .test_tokens import BYTES, gapless, library

RNG = random.Random(5)
BASE = [" ".join(RNG.choice("alpha beta gamma delta eta theta iota kappa la mu nu xi".split()) + str(RNG.randint(0, 400)) for _ in range(90)) for _ in range(6)]


def near(text, n):
    words = text.split(" ")
    for _ in range(n):
        words[RNG.randrange(len(words))] = f"new{RNG.randint(0, 999)}"
    return " ".join(words)


PASSAGE = "A passage that stands in many documents, café and all, long enough to be found again. "
COPIES = [(100 + i, near(BASE[i % 6], RNG.choice([0, 0, 1, 2, 3, 6])), "en", "s") for i in range(40)]
COPIES += [(200 + i, BASE[i] + " " + PASSAGE + BASE[5 - i], "en", "s") for i in range(4)]
ROWS = AWKWARD + COPIES


@pytest.fixture(scope="module")
def folder(save):
    return save(ROWS)


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


# personal data

KINDS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    found = [(m.start(), k, name, m.end()) for k, (name, pattern, ok) in enumerate(KINDS) for m in pattern.finditer(text) if ok(m[0])]
    return [f"{name}:{a}:{b}" for a, _, name, b in sorted(found)]


PII_TEXTS = [
    "mail a.b@c.de, and x@y.z_q@r.st; 1.2.3.4.5.6.7.8 or 256.1.1.1 and 01.002.3.255",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, call +1 (415) 555-2671.",
    "é😀 bob@example.com" * 3,
    " ".join(f"u{i}@h{i}.org" for i in range(300)),
    "IBAN GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33, ssn 123-45-6789 there 987-65-4321",
    "9" * 3000 + "@" + "a" * 3000,
    "+" * 2000 + "1" + "-" * 2000,
    "a@b.c\x0bd@e.f\n1-1-1-1 0000 0000 0000",
]


def test_op1(spark, save, empty):
    rows = [(i, t, "en", "s") for i, t in enumerate(PII_TEXTS)] + [(-1, None, None, None)]
    for r in pii.op1_pii(spark, save(rows)).collect():
        spans = base_spans((PII_TEXTS[r.doc_id] if r.doc_id >= 0 else None) or "")
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), r
        assert set(spans) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k[0] + ":") for s in spans) for k in KINDS]
    assert pii.op1_pii(spark, empty).count() == 0


def test_added_kinds_need_their_checksum_or_context(spark):
    out = pii.detect(spark.createDataFrame([(PII_TEXTS[4],), ("numbers 123-45-6789 alone",)], "text string"))
    kinds = [[s.kind for s in r.pii_spans] for r in out.collect()]
    assert kinds[0].count("iban") == 1 and kinds[0].count("ssn") == 1 and "ssn" not in kinds[1]


def test_secrets_need_letters_digits_and_context(spark):
    key = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"
    good = [f'token = "{key}" then', f"my PASSWORD:{key[:32]}", f"api-key {key * 3}"]
    bad = [f"commit {key} of main", f"token {key[:31]}", "secret " + "a" * 40, f"token {key * 4}", "token " + "word " * 40, "x" * 100_000]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    out = {r.i: [(x.kind, x.value) for x in r.pii_spans if x.kind == "secret"] for r in pii.detect(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert [out[i] for i in range(3)] == [[("secret", key)], [("secret", key[:32])], [("secret", key * 3)]]
    assert not any(out[i] for i in range(3, len(rows)))


def test_redaction_joins_overlapping_spans(spark):
    out = pii.detect(spark.createDataFrame([("x a@b.cd y 4111111111111111 z",), (None,), ("plain",)], "text string"))
    assert [r[0] for r in out.select(pii.redacted("text", "pii_spans")).collect()] == ["x <EMAIL> y <CARD> z", None, "plain"]


# language


def test_op2_learns_and_falls_back(spark, save, empty):
    words = {"en": "the house and water with people".split(), "de": "das haus und wasser mit leuten".split()}
    rows = [(i, " ".join(RNG.choices(words[lang], k=30)), lang, "s") for i in range(120) for lang in [("en", "de")[i % 2]]]
    rows += [(500, None, "en", "s"), (501, "123 ...", "de", "s"), (503, "½ ² Ⅷ", "de", "s"), (502, "housewater peopled", None, "s"), (None, "das haus", "de", "s")]
    got = {r.doc_id: r for r in langid.op2_langid(spark, save(rows)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[:120])
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(120))
    assert got[500].lang_pred == got[501].lang_pred == got[503].lang_pred == "und" and got[502].lang_pred == "en" and got[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.op2_langid(spark, empty).count() == 0


# language model


def test_op4(spark, folder, empty, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TEXT", 5000)
    monkeypatch.setattr(katz, "BUCKET_TEXT", 9000)
    tokens = [(d, ["<s>", *(t or "").encode().lower().split(), "</s>"]) for d, t, _, _ in ROWS]
    learned = [t for d, t in tokens if d is not None and zlib.crc32(str(d).encode()) % 10]
    uni = collections.Counter(w for t in learned for w in t[1:])
    bi = collections.Counter(p for t in learned for p in zip(t, t[1:], strict=False))
    n, v = sum(uni.values()), len(uni)
    ofs = lambda c: [0, *(collections.Counter(c.values())[r] for r in range(1, 7))]
    words, off = katz.Words.of(n, v, ofs(uni)), katz.discounts(ofs(bi))
    p1 = lambda w: (uni[w] - words.off[min(uni[w], 6)]) / n if uni[w] else words.unknown
    seen = lambda h: len(learned) if h == "<s>" else uni[h]
    left, over = collections.Counter(), collections.Counter()
    for (h, w), c in bi.items():
        left[h] += (c - off[min(c, 6)]) / seen(h)
        over[h] += p1(w)

    def p(w, h):
        if c := bi[h, w]:
            return (c - off[min(c, 6)]) / seen(h)
        return (1 - left[h]) / (1 - over[h]) * p1(w) if seen(h) else p1(w)

    assert sum(map(p1, uni)) + words.unknown == pytest.approx(1)
    for h in ["<s>", *list(uni)[:20]]:
        if h != "</s>":
            assert sum(p(w, h) for w in uni) + p("?", h) == pytest.approx(1)
    want = collections.defaultdict(list)
    for d, t in tokens:
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t[1:])
        want[d].append((len(t) - 1, sum(uni[w] > 0 for w in t[1:]), base, sum(math.log10(p(w, h)) for h, w in zip(t, t[1:], strict=False))))
    got = katz.op4_katz(spark, folder).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.train_tokens == n and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert any((r.n_tokens, r.n_known) == w[:2] and r.base_score == pytest.approx(w[2]) and r.score == pytest.approx(w[3]) for w in want[r.doc_id])
    assert katz.op4_katz(spark, empty).count() == 0


@pytest.mark.parametrize("order", [3, 4])
def test_op4_backs_off_over_all_orders(spark, folder, monkeypatch, order):
    monkeypatch.setattr(katz, "BLOCK_TEXT", 5000)
    monkeypatch.setattr(katz, "BUCKET_TEXT", 9000)
    tokens = [(d, ["<s>", *(t or "").encode().lower().split(), "</s>"]) for d, t, _, _ in ROWS]
    learned = [t for d, t in tokens if d is not None and zlib.crc32(str(d).encode()) % 10]
    grams = {k: collections.Counter(tuple(t[i - k + 1 : i + 1]) for t in learned for i in range(max(1, k - 1), len(t))) for k in range(1, order + 1)}
    ofs = lambda c: [0, *(collections.Counter(c.values())[r] for r in range(1, 7))]
    uni, n = grams[1], sum(grams[1].values())
    words, offs = katz.Words.of(n, len(uni), ofs(uni)), {k: katz.discounts(ofs(c)) for k, c in grams.items()}
    seen = lambda h: len(learned) if h == ("<s>",) else grams[len(h)][h]
    after = collections.defaultdict(list)
    for k in range(2, order + 1):
        for g in grams[k]:
            after[g[:-1]].append(g[-1])
    weights = {}

    def p(w, h):
        if not h:
            return (uni[w,] - words.off[min(uni[w,], 6)]) / n if uni[w,] else words.unknown
        if c := grams[len(h) + 1][*h, w]:
            return (c - offs[len(h) + 1][min(c, 6)]) / seen(h)
        if not seen(h):
            return p(w, h[1:])
        if h not in weights:
            weights[h] = (1 - sum(p(x, h) for x in after[h])) / (1 - sum(p(x, h[1:]) for x in after[h]))
        return weights[h] * p(w, h[1:])

    for h in [g for g in grams[order - 1] if g[-1] != "</s>"][:10]:
        assert sum(p(w, h) for (w,) in uni) + p("?", h) == pytest.approx(1)
    want = collections.defaultdict(list)
    for d, t in tokens:
        want[d].append(sum(math.log10(p(t[i], tuple(t[max(0, i - order + 1) : i]))) for i in range(1, len(t))))
    got = (QUERIES["op4_katz"](spark, folder) if order == 3 else katz.op4_katz(spark, folder, order)).collect()
    assert len(got) == len(ROWS)
    assert all(any(r.score == pytest.approx(w) for w in want[r.doc_id]) for r in got)


def test_katz_discounts_follow_the_data_however_steep(spark):
    made = [katz.discounts([0, *(round(10**7 * r**-s) for r in range(1, 7))]) for s in (1.5, 2.5, 3.2, 3.4, 5.0)]
    for r in range(1, 6):
        assert all(a[r] < b[r] < r for a, b in itertools.pairwise(made)), r
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    tokens = [["<s>", *(r.text or "").encode().lower().split(), "</s>"] for r in rows]
    found = []
    for k in (1, 2, 3):
        grams = collections.Counter(tuple(t[i - k + 1 : i + 1]) for t in tokens for i in range(max(1, k - 1), len(t)))
        counts = collections.Counter(grams.values())
        found.append(katz.discounts([0, *(counts[r] for r in range(1, 7))]))
    assert len({round(f[1], 3) for f in found}) == 3


def test_katz_discounts_are_good_turing_ratios_between_0_and_1():
    for c in ([0, 100, 50, 30, 20, 15, 12], [0, 9, 30, 40, 70, 80, 90], [0] * 7, [0, 5, 0, 0, 0, 0, 0], [0, 10**6, 10**4, 100, 5, 1, 0]):
        n, k = katz.smoothed(c), katz.GOOD_TURING_UP_TO
        off = katz.discounts(c)
        for r in range(1, k + 1):
            expected, a = (r + 1) * n[r + 1] / n[r], (k + 1) * n[k + 1] / n[1]
            assert 0 < (r - off[r]) / r < 1
            assert (r - off[r]) / r == pytest.approx((expected / r - a) / (1 - a))
        assert sum(n[r] * off[r] for r in range(1, k + 1)) == pytest.approx(n[1])  # what is freed is the mass of words seen once


# media


def test_op7(spark, awkward, empty):
    want = []
    for d, t, _, _ in AWKWARD:
        data = (t or "").encode()
        body = data + b"\xff" * (-len(data) % 576 if data else 576)
        want.append((d, len(data), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:])))
    got = media.op7_media(spark, awkward).collect()
    same([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got], want)
    by = collections.defaultdict(set)
    for r in got:
        by[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by.values())
    assert media.op7_media(spark, empty).count() == 0


@pytest.mark.parametrize("kind", range(5))
def test_png_filters_come_off(kind):
    rng = np.random.default_rng(kind)
    image = rng.integers(0, 256, (7, 20), dtype=np.uint8)
    lines = np.zeros_like(image)
    for y in range(7):
        for x in range(20):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            q = a + b - c
            paeth = a if abs(q - a) <= abs(q - b) and abs(q - a) <= abs(q - c) else b if abs(q - b) <= abs(q - c) else c
            lines[y, x] = (int(image[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256
    assert (media.unfiltered(np.full(7, kind, np.uint8), lines) == image).all()
    assert (media.read_png(media.write_png(image)) == image).all()


def test_png_checksums_are_tested():
    data = bytearray(media.write_png(np.zeros((2, 4), np.uint8)))
    data[45] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        media.read_png(bytes(data))


def test_features_of_small_changes_are_close():
    a = media.payload(BASE[0] * 3)
    b = media.payload(BASE[0] * 3 + "!")
    f = [int(media.feature(np.frombuffer(x, np.uint8).reshape(-1, media.ROW)), 16) for x in (a, b, media.payload(BASE[3] * 9))]
    assert (f[0] ^ f[1]).bit_count() < (f[0] ^ f[2]).bit_count()


# suffix arrays


def removed(rows, length):
    first = {}
    key = lambda d: math.inf if d is None else d
    for d, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(key(d), first.get(b[p : p + length], math.inf))
    out = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key(d):
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [50_000, 2])
def test_op8(spark, folder, empty, monkeypatch, hot):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(suffix_dedup, "TRIGGER_BUCKET_BYTES", 9000)
    monkeypatch.setattr(suffix_dedup, "PHRASE_BUCKET_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    same(suffix_dedup.op8_suffix_dedup(spark, folder).collect(), removed(ROWS, 50))
    assert suffix_dedup.op8_suffix_dedup(spark, empty).count() == 0


def test_op8_in_parts_of_buckets_and_pieces_of_blocks(spark, folder, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(suffix_dedup, "PHRASE_BUCKET_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    same(suffix_dedup.op8_suffix_dedup(spark, folder).collect(), removed(ROWS, 50))


def test_op8_makes_messages_in_proportion_to_the_text(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(suffix_dedup, "TRIGGER_BUCKET_BYTES", 96000)
    monkeypatch.setattr(suffix_dedup, "PHRASE_BUCKET_BYTES", 6000)
    made = []
    answer = suffix_dedup.answer

    def counted(messages, fn, kind):
        table = answer(messages, fn, kind)
        made.append(table.count())
        return table

    monkeypatch.setattr(suffix_dedup, "answer", counted)
    words = ["".join(RNG.choices("abcdefgh", k=6)) for _ in range(400)]
    lines = [" ".join(RNG.choices(words, k=12)) for _ in range(600)]
    for n in (600, 2400):
        rows = [(i, "\n".join(RNG.choices(lines, k=8))) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert suffix_dedup.deduplicated(docs).where("n_removed > 0").count()
    assert made[3] < 1.5 * 4 * made[1], made  # of four times the text


def test_suffix_ranks_are_the_suffix_order():
    data = bytes(RNG.choice(b"ab") for _ in range(300))
    rank = suffix_dedup.suffix_ranks(np.frombuffer(data, np.uint8), 50)
    suffixes = [data[i : i + 50] for i in range(251)]
    assert np.unique(rank, return_inverse=True)[1].tolist() == [sorted(set(suffixes)).index(s) for s in suffixes]


# quality


def measures(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_op9(spark, folder, empty):
    got = quality.op9_quality(spark, folder).collect()
    want = []
    for d, t, _, _ in ROWS:
        m = measures(t or "")
        want.append((d, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    same([tuple(r[:7]) for r in got], want)
    assert all(not (r.base_failed and r.kept) for r in got)
    assert quality.op9_quality(spark, empty).count() == 0


def test_expectation_maximisation_finds_the_better_rules():
    patterns, n = collections.Counter(), len(quality.RULES)
    for _ in range(3000):
        good = RNG.random() < 0.7
        patterns[tuple((1 if good == (RNG.random() < (0.95 if j < 4 else 0.6)) else -1) for j in range(n))] += 1
    share, rates = quality.estimated(sorted(patterns.items()))
    assert share == pytest.approx(0.7, abs=0.05)
    assert min(r[1][0] for r in rates[:4]) > 0.9 > 0.7 > max(r[1][0] for r in rates[4:])


# similarity


def classes_of(rows, k, percent):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(r[0], least.get(top(i), r[0]))
    return [(r[0], len(sets[i]), least[top(i)] if r[0] is not None else None) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("chunk", "small"), [(512, 16), (4, 2)])
def test_op10(spark, folder, empty, monkeypatch, chunk, small):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "SMALL", small)
    same(jaccard.op10_jaccard(spark, folder).collect(), classes_of(ROWS, 4, 85))
    assert jaccard.op10_jaccard(spark, empty).count() == 0


def test_op10_on_sizes_near_the_bound(spark, save):
    """Pairs at and just below 85 in 100, of all sizes, in one band and across two."""
    rows = []
    for n, size in enumerate([3, 4, 7, 8, 9, 12, 20, 21, 47, 60, 100, 170, 333, 900, 2400, 2500, 2941, 3300]):
        words = [f"w{n}x{i}" for i in range(size + 3)]
        rows.append((1000 * n, " ".join(words), "en", "s"))
        for k in (int(0.15 * size), int(0.15 * size) + 1, int(0.15 * size / 1.85), int(0.15 * size / 1.85) + 1):
            rows.append((1000 * n + 2 * k + 1, " ".join(words[k:]), "en", "s"))
            rows.append((1000 * n + 2 * k + 2, " ".join([f"v{n}x{k}x{i}" for i in range(k)] + words[k:]), "en", "s"))
    got = jaccard.op10_jaccard(spark, save(rows)).collect()
    same(got, classes_of(rows, 4, 85))


@pytest.mark.parametrize("few", [0, 32])
def test_op10_holds_an_open_pair_against_its_texts_once(spark, monkeypatch, few):
    """Long texts of common sections stand together in many tiles with ever other members, and bitmaps allow all their pairs."""
    rng, made, whole = random.Random(7), {}, jaccard.written
    sections = [" ".join(f"s{i}x{j}" for j in range(700)) for i in range(14)]
    rows = [(i, " ".join(sections[j] for j in sorted(rng.sample(range(14), 10)))) for i in range(12)]
    rows += [(20, rows[0][1] + " more words than that"), (21, rows[5][1].replace("s", "z", 40))]

    def counting(df, name):
        out = whole(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counting)
    monkeypatch.setattr(jaccard, "FEW", few, raising=False)
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same(got, classes_of(rows, 4, 85))
    if few:
        assert made["rest"] + made.get("single", 0) <= len(rows) * (len(rows) - 1) / 2, made


def test_op10_names_an_open_pair_once_for_tiles_with_the_same_members(spark, monkeypatch):
    rng, made, whole = random.Random(8), {}, jaccard.written
    sections = [" ".join(f"s{i}x{j}" for j in range(700)) for i in range(14)]
    rows = [(i, " ".join(sections[j] for j in sorted(rng.sample(range(14), 10)))) for i in range(12)]

    def counting(df, name):
        out = whole(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counting)
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same(got, classes_of(rows, 4, 85))
    assert made["single"] <= made["open"] <= 8 * made["single"], made


def test_op10_makes_rows_in_proportion_to_a_group_of_near_copies(spark, monkeypatch):
    """Twice the members of one group make twice the tile rows and pairs, and one class."""
    made = {}
    whole = jaccard.written

    def counting(df, name):
        out = whole(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counting)
    sizes = []
    words = [f"w{i}" for i in range(300)]
    for n in (700, 1400, 2800):
        made.clear()
        rng = random.Random(n)
        rows = []
        for i in range(n):
            w = list(words)
            for at in (rng.randrange(300), rng.randrange(300)):
                w[at] = f"x{i}"
            rows.append((i, " ".join(w)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r.component_id for r in jaccard.classes(df).collect()} == {0}
        sizes.append(dict(made))
    for name in ("tiles", "hubs", "pairs", "chunks", "open", "rest"):
        a, b, c = (s.get(name, 0) for s in sizes)
        assert b <= 2.4 * a + 50 and c <= 2.4 * b + 50, (name, sizes)


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(3)
    for n in [*range(1, 60), 200, 800, 2600]:
        base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        for percent in (80, 85):
            for lost, won in ((0, 1), (1, 0), (n // 12, n // 12), (0, n * 15 // 85), (n * 15 // 100, 0)):
                other = np.unique(np.concatenate([base[lost:], rng.integers(0, 1 << 63, won).astype(np.uint64)]))
                if len(other) and jaccard._alike(base, other, percent) and len(np.setxor1d(base, other)):
                    a, b = jaccard.meeting_keys([base, other], percent)
                    assert len(np.intersect1d(a, b)), (n, lost, won)


def test_components_of_a_long_path(spark):
    ids = list(range(60))
    RNG.shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")
    assert {r.component for r in graph.components(edges).collect()} == {0}


@pytest.mark.parametrize("few", [0, 10_000])
def test_components_by_rounds_and_at_once(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_LINKS", few)
    rng = random.Random(9)
    edges = [(rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(50)] + [(5, 5), (70, 71), (71, 70)]
    up = {n: n for e in edges for n in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    same(got, [(n, m) for n, m in up.items() if n != m])
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_bound_the_overlap():
    a, b = jaccard.shingle_set(BASE[0], 4), jaccard.shingle_set(near(BASE[0], 5), 4)
    bits = lambda s: np.frombuffer(jaccard.signature_of(s), np.uint8)
    assert np.unpackbits(bits(a) ^ bits(b)).sum() <= len(np.setxor1d(a, b))


# pipeline


def test_pipeline_stages(spark, save, empty):
    import corpus_pipeline as cp

    rows = [*ROWS, (900, "Write to jane@example.org about the cat and the mat, " + near(BASE[2], 60), "en", "s"), (901, "### 123 ###", "en", "s")]
    path = save(rows)
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("pii_spans", F.lit("x")).withColumn("component_id", F.lit(1))
    names = docs.columns
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.written(stage(spark, docs, path), name)
        assert docs.columns == names
        kept[name] = docs.select("doc_id", "text", "lang", "source").collect()
    whole = collections.Counter((r[0], r[1], r[2], r[3]) for r in rows)
    language = [tuple(r) for r in kept["language"]]
    assert not collections.Counter(language) - whole and {901, 3, 4, 11} & {r[0] for r in language} == set()
    assert {900, 1, 2, 7} <= {r[0] for r in language}
    # one row of each class, that of the smallest id, and all rows without an id
    want = {d for d, _, c in classes_of(language, 5, 80) if d == c}
    near_ = [tuple(r) for r in kept["near_duplicates"]]
    assert sorted(r[0] for r in near_ if r[0] is not None) == sorted(x for x in want if x is not None) and len(want) < len(set(language))
    assert [r for r in near_ if r[0] is None] == [r for r in language if r[0] is None]
    assert not set(near_) - set(language)
    # what the plain removal keeps of each text
    hashes = {r[0]: r[4] for r in removed([r for r in near_ if r[0] is not None], 50)}
    cut = {r.doc_id: r.text for r in kept["repeated_passages"]}
    same_, less = 0, 0
    for d, t, *_ in near_:
        if d is not None and hashlib.sha256((cut[d] or "").encode()).hexdigest() == hashes[d]:
            same_ += 1
            less += len(cut[d] or "") < len(t or "")
    assert same_ >= len(hashes) - 2 and less  # but for a character that is cut in two
    # base spans of plain patterns become their kinds
    for d, t, *_ in kept["personal_data"]:
        before = cut[d]
        assert not base_spans(t or "") and (base_spans(before or "") or t == before or "<" in t)
    left = {r.doc_id: r for r in docs.collect()}
    assert "<EMAIL>" in left[900].text and "jane@" not in left[900].text
    assert all(r.n_chars == len(r.text) for r in left.values())
    packed = cp.STAGES[-1][1](spark, docs, path).collect()
    encode = library(BYTES)
    for d, r in left.items():
        ids = np.array([*encode(r.text or ""), 0], "<u4")
        pieces = sorted((x for x in packed if x.doc_id == d), key=lambda x: x.piece)
        assert [x.start for x in pieces] == [0, *np.cumsum([x.length for x in pieces])[:-1]] and sum(x.length for x in pieces) == len(ids)
        assert [x.ids_crc32 for x in pieces] == [zlib.crc32(ids[x.start : x.start + x.length].tobytes()) for x in pieces]
    bins = gapless([(x.sequence_id, x.offset, x.length) for x in packed], 2048)
    assert bins <= -(-sum(x.length for x in packed) // 2048) + 1
    assert {tuple(r) for r in cp.run(spark, path).select("doc_id", "piece", "ids_crc32").collect()} == {(x.doc_id, x.piece, x.ids_crc32) for x in packed}
    assert cp.run(spark, empty).count() == 0


def test_items_counted_alike_share_their_scores_in_a_worker_too():
    rows = [(kind, f"{a}{b}", lang, 1) for kind in (0, 2) for a in "abcdefgh" for b in "abcdefgh" for lang in ("de", "en") if (a < b) == (lang == "de")]
    model = pickle.loads(pickle.dumps(langid.Model(rows)))
    assert {kind: len({id(v) for v in items.values()}) for kind, items in model.tables.items()} == {0: 2, 2: 2}
    assert model.predict("ab")[0] == "de" and model.predict("ba")[0] == "en"
