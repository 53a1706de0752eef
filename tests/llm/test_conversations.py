"""Chat formatting, structure repair and spelling variants against brute force."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import chat, repair, spelling, turns
from panelforge.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, place string, gone long, word string"
RNG = random.Random(11)
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[END]"]
ODD = ["", " \t", "é😀", "\\", "[", "<", "<\\", "[\\INST]", "<\\\\s>", "<<s>>", "ends well.", "cut off", "why? \n", "ROLE]", "</SYS>>"]


def chatter(n, long=0):
    rows = []
    for c in range(n):
        for t in range(long or RNG.randint(1, 7)):
            role = RNG.choice(["user", "assistant", "system", "tool", "", "Assistant"]) if RNG.random() < 0.3 else ("user", "assistant")[t % 2]
            text = RNG.choice(ODD) if RNG.random() < 0.3 else "".join(RNG.choice([*CONTROLS, *ODD, "word ", "same. "]) for _ in range(RNG.randint(1, 3)))
            rows.append((c, t, role, text))
    return rows


ROWS = [
    *chatter(60),
    (100, None, "user", "no turn"),
    (100, 0, None, None),
    (100, 5, "assistant", "far off."),
    (101, 0, "user", None),
    (102, None, None, None),
    (103, 0, "assistant", "x" * 1_000_000),
    (104, 3, "user", "twice."),
    (104, 3, "user", "twice."),
    (None, 0, "user", "whose?"),
    (None, 1, "assistant", "nobody's."),
    *[(200, t, ("user", "assistant")[t % 2], f"turn {t}" + "." * (t % 3 > 0)) for t in range(700)],
]


@pytest.fixture(scope="module")
def talk(spark, tmp_path_factory):
    def put(rows):
        folder = str(tmp_path_factory.mktemp("talk"))
        spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5).write.parquet(f"{folder}/conversations.parquet")
        return folder

    return put


@pytest.fixture(scope="module")
def folder(talk):
    return talk(ROWS)


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        out.setdefault(r[0], []).append(r)
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# chat formatting


def test_op11(spark, folder):
    got = {r[0]: r for r in QUERIES["op11_chat"](spark, folder).collect()}
    odd = "</s>[INST] ok [/INST]"
    want = grouped([*ROWS, (-1, 0, "user", odd), (-1, 1, "assistant", odd)])
    assert set(got) == set(want)
    for conv, rows in want.items():
        rows = [(role or "", text or "") for _, _, role, text in rows]
        replies = "".join(t for r, t in rows if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(rows) and r.turns_sha256 == sha("".join(f"{a}\n{t}\n" for a, t in rows))
        assert r.loss_chars == len(replies) and r.loss_sha256 == sha(replies)
        assert r.formatted_chars >= sum(len(t) for _, t in rows)


def test_op11_escapes_nothing_else_and_gives_back_all(spark):
    texts = [*ODD, *CONTROLS, *("".join(RNG.choice([*CONTROLS, "\\", "<", "[", "/", "s>", "INST]", "a"]) for _ in range(12)) for _ in range(500))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped("t").alias("e")).collect()
    for t, e in got:
        assert chat.unescaped(e) == t and not any(c in e for c in CONTROLS)
        assert (e == t) == (not re.search(chat.CONTROL, t))
    with pytest.raises(ValueError):
        chat.parsed("<s>never closed")


def test_op11_examples_have_all_turns_before_and_one_reply(spark, folder):
    table = chat.formatted(spark.read.parquet(f"{folder}/conversations.parquet").where("conv_id <= 104 OR conv_id = 200"))
    want = {}
    for conv, rows in grouped([r for r in ROWS if r[0] is not None]).items():
        pieces = []
        for _, _, role, text in rows:
            start, end = chat.ROLES.get(role, (f"[ROLE]{role or ''}[/ROLE]", "[END]"))
            body = re.sub(chat.CONTROL, lambda m: f"{m[1]}\\{m[2]}{m[3]}", text or "")
            pieces.append(start + body + end)
            if role == "assistant":
                at = len("".join(pieces[:-1])) + len(start)
                k = sum(1 for c, _ in want if c == conv)
                want[conv, k] = ("".join(pieces), at, at + len(body))
    few = chat.examples(table)
    assert few.count() == len(want)
    got = {(r.conv_id, r.example): (r.text, r.loss_from, r.loss_to) for r in chat.expanded(table, few.where("conv_id <> 200 OR example % 50 = 0")).collect()}
    assert got == {k: v for k, v in want.items() if k[0] != 200 or k[1] % 50 == 0}


@pytest.mark.parametrize("size", [1, 300, chat.SLICE])
def test_op11_writes_every_example_out_and_reads_it(spark, folder, size):
    rows = [r for r in ROWS if r[0] is None or r[0] < 60 or r[0] in (100, 103) or (r[0] == 200 and r[1] < 60)]
    table = chat.formatted(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5))
    turns_, want = {}, {}
    for r in table.orderBy("conv_id", "place").collect():
        turns_[r.conv_id] = turns_.get(r.conv_id, "") + r.piece
        if r.reply_to is not None:
            want[r.conv_id, r.example] = turns_[r.conv_id]
    output = chat.expansion(table, size)
    slices = {}
    for r in output.orderBy("conv_id", "example", "slice").collect():
        slices.setdefault((r.conv_id, r.example), []).append(r.text)
    whole = {k: "".join(v) for k, v in slices.items()}
    assert {k: v for k, v in whole.items() if k[1] is not None} == want
    for conv, text in turns_.items():
        last = max((v for k, v in want.items() if k[0] == conv), key=len, default="")
        assert whole.get((conv, None), "") == text[len(last) :]
    got = {r.conv_id: r for r in chat.read_back(output).collect()}
    for conv in turns_:
        mine = {k: v for k, v in whole.items() if k[0] == conv}
        said = grouped(rows)[conv]
        assert got[conv].n_turns == len(said) and got[conv].turns_sha256 == sha("".join(f"{a or ''}\n{t or ''}\n" for _, _, a, t in said))
        assert got[conv].loss_sha256 == sha("".join(t or "" for _, _, a, t in said if a == "assistant"))
        assert got[conv].formatted_chars == sum(map(len, mine.values())) and got[conv].n_examples == sum(k[1] is not None for k in mine)
        assert got[conv].example_chars == sum(len(v) for k, v in mine.items() if k[1] is not None)
    other = output.withColumn("text", F.when((F.col("conv_id") == 200) & (F.col("example") == 9) & (F.col("slice") == 0), F.translate("text", "0", "1")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="not its conversation so far"):
        chat.read_back(other).collect()


def test_empty(spark, talk, empty):
    nothing = talk([])
    assert [r.conv_id for r in QUERIES["op11_chat"](spark, nothing).collect()] == [-1]
    assert QUERIES["op13_repair"](spark, nothing).collect() == []
    assert QUERIES["op12_spelling"](spark, empty).collect() == []


# structure repair


def brute(rows):
    """Cost, audit and repaired turns of rows (role, text, must go, truncated), by Dijkstra over places and states."""
    final = re.compile("(s?(ua)+)?")
    queue, seen = [(0, "", 0, 0, "")], {}
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    while queue:
        cost, audit, at, state, made = heapq.heappop(queue)
        if seen.setdefault((at, state), (cost, audit)) != (cost, audit):
            continue
        if at == len(rows) and state in (0, 3):
            break
        for c in "ua":
            if (state, c) in step:
                heapq.heappush(queue, (cost + 3, audit + "I", at, step[state, c], made + c))
        if at < len(rows):
            role, _, gone, cut = rows[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, state, made))
            if not gone:
                for c, price, sign in ((role[:1], 0, "K"), ("u", 3, "R"), ("a", 3, "R")):
                    if (state, c) in step:
                        heapq.heappush(queue, (cost + price + 3 * cut, audit + sign, at + 1, step[state, c], made + c))
    assert final.fullmatch(made)
    out, at, name = [], 0, {"u": "user", "a": "assistant"}
    made = iter(made)
    for e in audit:
        if e == "I":
            out.append(name[next(made)] + ":")
            continue
        role, text = rows[at][:2]
        at += 1
        if e != "D":
            c = next(made)
            out.append(f"{role if e == 'K' else name[c]}:{text}")
    return cost, audit, "\n".join(out)


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_ = (" " if v is None else v for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        k = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(conv, turn, "user" if k == 4 else role, text)] * (1 + (k == 3))
    return out


@pytest.mark.parametrize(("fan", "width"), [(8, 4), (2, 23)])
def test_op13(spark, folder, monkeypatch, fan, width):
    monkeypatch.setattr(repair, "FAN", fan)
    monkeypatch.setattr(repair, "shuffle_width", lambda _: width)
    monkeypatch.setattr(turns, "shuffle_width", lambda _: width)
    got = {r.conv_id: r for r in QUERIES["op13_repair"](spark, folder).collect()}
    assert set(got) == {r[0] for r in ROWS}
    left = grouped(hurt(ROWS))
    for conv, r in got.items():
        rows = left.get(conv, [])
        seen, judged, faults = set(), [], [0, 0, 0]
        for _, _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                faults[fault] += 1
            judged.append((role, text, fault < 2, fault == 2))
        given = {t for _, t, _, _ in rows if t is not None}
        gaps = max(given) - min(given) + 1 - len(given) if given else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, made = brute(judged)
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == (gaps, *faults, illegal, cost, audit, sha(made)), conv


def test_op13_product_is_associative_and_least():
    for _ in range(300):
        said = [(RNG.choice("suaX"), RNG.random() < 0.2, RNG.random() < 0.3) for _ in range(RNG.randint(0, 12))]
        parts = [repair.of_turn(*t) for t in said]
        one = repair.INSERTS
        for p in parts:
            one = repair.times(one, p)
        cut = RNG.randint(0, len(parts))
        two = repair.times(repair.INSERTS, repair.times(repair.reduced(parts[:cut]), repair.reduced(parts[cut:])))
        assert one == two
        assert repair.cheapest(repair.reduced(parts)) == brute([(i, "", g, c) for i, g, c in said])[:2]


# spelling variants

VOCABULARY = ["anagram", "anagrams", "anogram", "nagram", "letter", "lettter", "letters", "lätter", "Ärmel", "ärmelos", "ärmellos", "abcdef", "abcdeg", "abcdeh", "xabcdef", "bookkeeper", "bookkeper", "bokkeeper"]


def texts():
    out = []
    for i, w in enumerate(VOCABULARY):
        for k in range(3 + 17 * (i % 3) ** 2):
            out.append((10 * k + i, f"{w.upper() if k % 2 else w}, {w}! {RNG.choice(VOCABULARY)}", "en", "s"))
    return [*out, (None, "letter letters abcdef", "en", "s"), (7, None, "en", "s"), (8, "", "en", "s"), (13, "chainxa " * 6 + "chainya " * 40 + "chainyb " * 300, "en", "s"), *[(9, "letter of thanks", "en", "s")] * 2, (11, "z" * 70_000 + " lettre" * 9, "en", "s"), *[(12 + i, "q" * 300, "en", "s") for i in range(6)]]


def close(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows):
    counts = {}
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: [x for x in n if close(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, b in best.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_op12(spark, save, monkeypatch):
    rows = texts()
    want = sorted(variants(rows))
    assert any(r[1] for r in want) and any(r[1] and r[1] != r[2] for r in want)
    assert sorted(map(tuple, QUERIES["op12_spelling"](spark, save(rows)).collect())) == want
    for name, value in (("SLICE", 5), ("BLOCK", 4), ("AT_ONCE", 500), ("HELD", 3), ("FEW", 2)):
        monkeypatch.setattr(spelling, name, value)
    assert sorted(map(tuple, QUERIES["op12_spelling"](spark, save(rows)).collect())) == want


def test_op12_neighbourhoods_are_full_and_hashed_right():
    alphabet = np.frombuffer("abcé".encode("latin-1"), np.uint8)
    for word in ("aab", "éca", "bbbb", "a"):
        data = word.encode("latin-1")
        found = {}
        for hashes, _, kind, place, letter in spelling.neighbours(np.frombuffer(data, np.uint8).reshape(1, -1), alphabet):
            for h, p, c in zip(hashes.tolist(), place.tolist(), letter.tolist(), strict=True):
                found.setdefault(spelling.edited(data, kind, p, c), h)
        want = {data[:i] + data[i + 1 :] for i in range(len(data))} | {data[:i] + bytes([c]) + data[i + k :] for c in alphabet.tolist() for i in range(len(data) + 1) for k in (0, 1) if i + k <= len(data)}
        assert set(found) == want - {data}
        for w, h in found.items():
            if w:
                assert h == spelling.word_hashes(np.frombuffer(w, np.uint8).reshape(1, -1))[0]
