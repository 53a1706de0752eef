"""Structure repair of conversations by a min-plus scan over turns.

What a conversation should be: roles whose initials match (s?(ua)+)?, without blank or repeated
turns. Edits keep, rerole, delete or insert turns. Each turn is a 4 x 4 matrix over the states
of that pattern's automaton; its entries are the cheapest way from state to state, as pairs of
cost and audit (the edits' initials), and it is closed under inserts. Costs add and audits join
in the product; the less pair by cost, then by audit, is the sum. Of two cheapest ways between
two states over the same turns, neither audit begins with the other (that would be inserts
that come back to a state, which cost), so the order of audits outlives joining on both sides,
and the product is associative. Partitions hold rows in order (turns.in_order), so they reduce
what they have of a conversation in a tree, then levels of FAN elements do, until a conversation
is one element. An audit fixes the repaired roles, so a last pass over rows in order, led by the
audit, gives the repaired conversation with nothing but a running state.

Tables hold rows (conv_id, turn, role, text). Null roles and texts count as one space; rows go
by turn, nulls first, then role, a hash of the text and the input's order. Equal rows of one
conversation are duplicates. A null conv_id is a conversation. A row's first fault of blank,
duplicate and truncated counts. Conversations without rows give zeros, an empty audit and the
hash of nothing. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import in_slices, shuffle_width, written
from panelforge.llm.turns import conversations, each_conversation, in_order, part

#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS, STOPS, LEGAL = " \t\n\x0b\x0c\r", ".!?", ("su", "ua", "au")
#: States: nothing yet, after s, after u, after a. Where an initial leads, and where a conversation may end.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS, STATES = (0, 3), range(4)
#: The one of user and assistant that may come next.
NEXT = {i: c for (i, c) in STEPS if c != "s"}
WORD = {"u": "user", "a": "assistant"}
FAN = 8
#: Rows of a conversation that a task has as single matrices at once.
RUN = 64

Element = dict[tuple[int, int], tuple[int, str]]


def times(a: Element, b: Element) -> Element:
    """The min-plus product."""
    out: Element = {}
    from_state: dict[int, list] = {}
    for (j, k), (cost, audit) in b.items():
        from_state.setdefault(j, []).append((k, cost, audit))
    for (i, j), (cost, audit) in a.items():
        for k, more, then in from_state.get(j, ()):
            new, at = cost + more, (i, k)
            old = out.get(at)
            if old is None or new < old[0] or new == old[0] and audit + then < old[1]:
                out[at] = (new, audit + then)
    return out


def _closure() -> Element:
    """Inserts only."""
    out: Element = {(i, i): (0, "") for i in STATES}
    for i in STATES:
        j, n = STEPS[i, NEXT[i]], 1
        while (i, j) not in out:
            out[i, j] = (INSERT * n, "I" * n)
            j, n = STEPS[j, NEXT[j]], n + 1
    return out


INSERTS = _closure()
_turns: dict[tuple, Element] = {}


def of_turn(initial: str, must_go: bool, truncated: bool) -> Element:
    """A turn's matrix, inserts after it included."""
    key = (initial if initial in ("s", "u", "a") else "", must_go, truncated)
    if key not in _turns:
        way: Element = {(i, i): (DELETE, "D") for i in STATES}
        stay = TRUNCATED if truncated else 0
        if not must_go:
            for i in STATES:
                j = STEPS[i, NEXT[i]]
                way[i, j] = min(way.get((i, j), (REROLE + stay, "R")), (REROLE + stay, "R"))
                if (i, initial) in STEPS:
                    j = STEPS[i, initial]
                    way[i, j] = min(way.get((i, j), (stay, "K")), (stay, "K"))
        _turns[key] = times(way, INSERTS)
    return _turns[key]


def reduced(elements: Iterable[Element]) -> Element:
    """The product in order, as a balanced tree, so that audits are joined a logarithmic number of times."""
    stack: list[tuple[int, Element]] = []
    for e in elements:
        size = 1
        while stack and stack[-1][0] == size:
            e = times(stack.pop()[1], e)
            size *= 2
        stack.append((size, e))
    out: Element = {(i, i): (0, "") for i in STATES}
    while stack:
        out = times(stack.pop()[1], out)
    return out


def cheapest(e: Element) -> tuple[int, str]:
    """Cost and audit of the whole conversation."""
    done = times(INSERTS, e)
    return min(done[0, k] for k in ENDS if (0, k) in done)


#: Counts of a stretch of rows: rows, faults, illegal neighbours, turns that differ; first and last initial and turn.
STRETCH = "n long, blank long, duplicate long, truncated long, illegal long, turns long, first string, last string, low long, high long, ways array<struct<i:int,k:int,cost:long,audit:string>>"


def _joined(parts: list[dict]) -> dict:
    """Stretches of one conversation, in order, as one."""
    out = dict(parts[0])
    for x in parts[1:]:
        if not x["n"]:
            continue
        if not out["n"]:
            out = dict(x)
            continue
        for c in ("n", "blank", "duplicate", "truncated", "illegal", "turns"):
            out[c] += x[c]
        out["illegal"] += out["last"] + x["first"] not in LEGAL
        if x["low"] is not None:
            out["turns"] -= out["high"] == x["low"]
            out["low"] = x["low"] if out["low"] is None else out["low"]
            out["high"] = x["high"]
        out["last"] = x["last"]
    out["ways"] = _packed(reduced(map(_unpacked, (x["ways"] for x in parts))))
    return out


def _packed(e: Element) -> list[dict]:
    return [{"i": i, "k": k, "cost": c, "audit": a} for (i, k), (c, a) in sorted(e.items())]


def _unpacked(ways: list[dict]) -> Element:
    return {(w["i"], w["k"]): (w["cost"], w["audit"]) for w in ways}


def marked(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, gone) in order and written, with initial, blank, truncated and digest; gone rows only keep their conversation in the result."""
    text = F.coalesce("text", F.lit(" "))
    bare = F.rtrim(text, F.lit(BLANKS))
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), "gone", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(*STOPS)).alias("truncated"))
    table = in_order(clean)
    return table.withColumns({"initial": F.substring("role", 1, 1), "digest": F.unhex(F.md5(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text"))))})


def duplicates(table: DataFrame) -> DataFrame:
    """conv_id, digest and first, of what stands more than once in a conversation. Counted before it is shuffled."""
    same = table.where(~F.col("gone") & ~F.col("blank")).groupBy("conv_id", "digest").agg(F.count(F.lit(1)).alias("times"), F.min("place").alias("first"))
    return same.where("times > 1").select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")


def stretches(table: DataFrame) -> DataFrame:
    """An element for each conversation and partition of in_order()."""

    def run(batches):
        import pyarrow as pa

        last, state, run_of, done = None, None, [], []

        def shorter():
            state["tree"].append((1, reduced(run_of)))
            run_of.clear()
            while len(state["tree"]) > 1 and state["tree"][-1][0] == state["tree"][-2][0]:
                (size, b), (_, a) = state["tree"].pop(), state["tree"].pop()
                state["tree"].append((2 * size, times(a, b)))

        def end():
            if run_of:
                shorter()
            way = reduced([])
            for _, e in reversed(state.pop("tree")):
                way = times(e, way)
            done.append(state | {"ways": _packed(way)})

        def batch():
            out = pa.RecordBatch.from_pylist(done, schema=schema)
            done.clear()
            return out

        for b in batches:
            for conv, at, turn, initial, gone, blank, again, cut in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if last != (conv, at):
                    if state:
                        end()
                    last, state = (conv, at), {"conv_id": conv, "part": at, "n": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "first": None, "last": None, "low": None, "high": None, "tree": []}
                if gone:
                    continue
                again, cut = again and not blank, cut and not blank and not again
                for c, yes in (("n", True), ("blank", blank), ("duplicate", again), ("truncated", cut)):
                    state[c] += yes
                if state["n"] == 1:
                    state["first"] = initial
                else:
                    state["illegal"] += state["last"] + initial not in LEGAL
                state["last"] = initial
                if turn is not None:
                    state["turns"] += turn != state["high"]
                    state["low"], state["high"] = turn if state["low"] is None else state["low"], turn
                run_of.append(of_turn(initial, blank or again, cut))
                if len(run_of) == RUN:
                    shorter()
            if len(done) > 1000:
                yield batch()
        if state:
            end()
        if done:
            yield batch()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = table.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, part int, {STRETCH}"
    schema = to_arrow_schema(StructType.fromDDL(out))
    again = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    flagged = table.join(duplicates(table), again, "left").select("conv_id", part().alias("part"), "turn", "initial", "gone", "blank", (F.coalesce("first", "place") < F.col("place")).alias("again"), "truncated", "place")
    return flagged.repartition(shuffle_width(table.sparkSession), "part", "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "place").mapInArrow(run, out)


def whole(parts: DataFrame, count: int) -> DataFrame:
    """One element for each conversation: levels of FAN neighbours, over count partitions in all."""

    def run(group):
        import pandas as pd

        rows = [dict(r) for r in group.sort_values("part").to_dict("records")]
        for r in rows:
            r |= {c: None for c in ("low", "high") if pd.isna(r[c])}
            r |= {c: int(r[c]) for c in ("low", "high") if r[c] is not None}
        made = _joined(rows) | {"part": rows[0]["part"] // FAN}
        return pd.DataFrame([made])[list(group.columns)].astype({"low": "Int64", "high": "Int64"})

    names = parts.columns
    while count > 1:
        several = parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("conv_id").alias("_conv"))
        # a partition's border cuts one conversation, so several has fewer rows than there are partitions
        held = parts.join(F.broadcast(several), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
        alone = held.where("_conv IS NULL AND conv_id IS NOT NULL").select(names)
        level = held.where("_conv IS NOT NULL OR conv_id IS NULL").select(names)
        parts = written(alone.unionByName(level.groupBy("conv_id", F.floor(F.col("part") / FAN)).applyInPandas(run, parts.schema)), "elements")
        count = -(-count // FAN)
    return parts


def repaired(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and the repaired conversation's hash, for each conv_id of rows (conv_id, turn, role, text, gone)."""
    table = marked(rows)
    parts = whole(written(stretches(table), "elements"), shuffle_width(rows.sparkSession))

    def audits(batches):
        import pyarrow as pa

        for b in batches:
            found = [cheapest(_unpacked(ways)) if n else (0, "") for n, ways in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[3:], pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=names)

    def passed(batches):
        """Rows in order, each conversation led by its audit: the hash of what the audit makes of them."""
        import pyarrow as pa

        last, state, done = None, None, []

        def put(role, text):
            state["hash"].update(f"{chr(10) if state['any'] else ''}{role}:{text}".encode())
            state["any"] = True
            state["at"] = STEPS[state["at"], role[:1]]

        def inserted():
            while state["audit"][state["next"] : state["next"] + 1] == "I":
                state["next"] += 1
                put(WORD[NEXT[state["at"]]], "")

        def end():
            inserted()
            done.append(state["given"] + (state["audit"], state["hash"].hexdigest()))

        def batch():
            columns = list(zip(*done, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=result)
            done.clear()
            return out

        for b in in_slices(batches, 3):
            for conv, gone, role, text, *given in zip(*(b.column(i).to_pylist() for i in range(4 + len(counts) + 1)), strict=True):
                *numbers, audit = given
                if last != (conv,):
                    if state:
                        end()
                    last, state = (conv,), {"given": (conv, *numbers), "audit": audit, "next": 0, "at": 0, "any": False, "hash": hashlib.sha256()}
                    continue
                if gone:
                    continue
                inserted()
                edit = state["audit"][state["next"]]
                state["next"] += 1
                if edit == "K":
                    put(role, text)
                elif edit == "R":
                    put(WORD[NEXT[state["at"]]], text)
            if done:
                yield batch()
        if state:
            end()
            yield batch()

    from pyspark.sql.pandas.types import to_arrow_type

    kind = table.schema["conv_id"].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    names = ["conv_id", *counts, "audit"]
    result = [*names, "repaired_sha256"]
    longs = ", ".join(f"{c} long" for c in counts)
    types = [to_arrow_type(table.schema["conv_id"].dataType), *["int64"] * len(counts), "string", "string"]
    gaps = F.coalesce((F.col("high") - F.col("low") + 1 - F.col("turns")), F.lit(0)).alias("gaps")
    asked = parts.select("conv_id", "n", "ways", gaps, "blank", "duplicate", "truncated", "illegal")
    heads = asked.mapInArrow(audits, f"conv_id {kind}, {longs}, audit string")
    lead = heads.select("conv_id", F.lit(False).alias("gone"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *counts, "audit", F.lit(-1).cast("long").alias("place"))
    body = table.select("conv_id", "gone", "role", "text", *[F.lit(None).cast("long").alias(c) for c in counts], F.lit(None).cast("string").alias("audit"), "place")
    return each_conversation(lead.unionByName(body), "place").mapInArrow(passed, f"conv_id {kind}, {longs}, audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """rows with faults by the hash of their conversation and turn; dropped ones are marked as gone."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % 20
    text, role = given("text"), given("role")
    hurt = rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, STOPS, "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"),
    )
    return hurt.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(conversations(spark, sf_dir)))
