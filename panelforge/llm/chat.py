r"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own.

An example's text is all turns before its reply, and then the reply, of which alone is trainable;
all examples are written out. So the output grows with the square of a conversation's turns, which
is the method's. A conversation's formatted text is cut between turns into blocks of SLICE
characters and the rest of a turn that begins in one; an example has a row, a slice, for each
block, so that no row and no task holds a long conversation. Turns after the last reply are in no
example; they are written once, as rows without an example's number, since the output gives back
whole conversations.

Template: <s>assistant</s>, [INST]user[/INST], <<SYS>>system<</SYS>>, and for any other role
[ROLE]role[/ROLE]text[END]. A control string inside a text or role gets a backslash after its
first character, and one that has backslashes there already gets one more; taking one away
undoes it. After that no control string stands in a text, and none can begin in a text and end
in the template, so the first one that is found closes the turn.

Null texts and roles are empty. Rows go by turn (nulls first), then role, a hash of the text
and the input's order; equal rows are turns of their own. A null conv_id is a conversation.
A conversation of any length lies in as many partitions as range partitioning gives it; running
sums are made inside partitions and bases added from the rows of those that a partition's
border cuts, of which there are two for each partition at most. Reading back reads every slice: its
context gives a checksum, and what it adds to earlier examples is parsed. The digests alone are
sequential and go through one conversation's added texts after another with a running state, which
compares all checksums with the text so far.
An empty table gives an empty output; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import in_slices, shuffle_width, step_done, written
from panelforge.llm.turns import conversations, each_conversation, in_order, part

#: Opening and closing strings by role, and those of other roles.
ROLES = {"assistant": ("<s>", "</s>"), "user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER, AFTER_ROLE, END = "[ROLE]", "[/ROLE]", "[END]"
#: A control string, split after its first character, with any backslashes there.
CONTROL = r"([\[<])(\\*)((?:/?s>)|(?:<SYS>>)|(?:</SYS>>)|(?:/?INST\])|(?:/?ROLE\])|(?:END\]))"
#: Characters after which a block of a conversation ends.
SLICE = 1 << 16
_BATCH = 4 << 20
_ESCAPED = re.compile(CONTROL.replace(r"(\\*)", r"\\(\\*)"))


def escaped(text):
    """A text column whose control strings all have a backslash more."""
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1\\$2$3"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def turns_in(text: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of formatted turns; a ValueError for what is none."""

    def until(end: str, at: int) -> int:
        if (found := text.find(end, at)) < 0:
            raise ValueError("not a formatted turn")
        return found

    at = 0
    while at < len(text):
        for role, (start, end) in ROLES.items():
            if text.startswith(start, at):
                stop = until(end, at + len(start))
                yield role, unescaped(text[at + len(start) : stop])
                break
        else:
            if not text.startswith(OTHER, at):
                raise ValueError("not a formatted turn")
            middle = until(AFTER_ROLE, at + len(OTHER))
            end, stop = END, until(END, middle + len(AFTER_ROLE))
            yield unescaped(text[at + len(OTHER) : middle]), unescaped(text[middle + len(AFTER_ROLE) : stop])
        at = stop + len(end)


def parsed(piece: str) -> tuple[str, str]:
    """Role and text of one formatted turn; a ValueError for what is none."""
    (turn,) = turns_in(piece)
    return turn


def pieces(rows: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, place, piece, and reply_from and reply_to, the trainable part of the piece, null where there is none."""
    text, role = escaped(F.col("text")), F.col("role")
    piece = F.concat(F.lit(OTHER), escaped(role), F.lit(AFTER_ROLE), text, F.lit(END))
    for name, (start, end) in ROLES.items():
        piece = F.when(role == name, F.concat(F.lit(start), text, F.lit(end))).otherwise(piece)
    start, end = ROLES["assistant"]
    reply = role == "assistant"
    out = rows.select("conv_id", "place", piece.alias("piece"), reply.alias("reply"))
    size = F.length("piece").cast("long")
    return out.select("conv_id", "place", "piece", F.when(F.col("reply"), F.lit(len(start)).cast("long")).alias("reply_from"), F.when(F.col("reply"), size - len(end)).alias("reply_to"))


def running(table: DataFrame) -> DataFrame:
    """pieces with turn_no, example and start: earlier turns, replies and characters of the conversation in this partition."""

    def run(batches):
        import pyarrow as pa

        last, sums = None, (0, 0, 0)
        for b in in_slices(batches, 2):
            made = []
            for conv, piece, reply in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                if last != (conv,):
                    last, sums = (conv,), (0, 0, 0)
                made.append(sums)
                sums = (sums[0] + 1, sums[1] + (reply is not None), sums[2] + len(piece))
            if made:
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in zip(*made, strict=True))], names=[*b.schema.names, "turn_no", "example", "start"])

    kind = table.schema["conv_id"].dataType.simpleString()
    return table.mapInArrow(run, f"conv_id {kind}, place long, piece string, reply_from long, reply_to long, turn_no long, example long, start long")


def formatted(rows: DataFrame) -> DataFrame:
    """For rows (conv_id, turn, role, text) every turn's piece with its place, in a written table. expansion() makes the examples of it."""
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    local = in_order(clean, lambda df: running(pieces(df)))
    size, reply = F.length("piece").cast("long"), F.col("reply_to").isNotNull().cast("long")
    ends = local.groupBy("conv_id", part().alias("part")).agg((F.max("turn_no") + 1).alias("turns"), F.max(F.col("example") + reply).alias("replies"), F.max(F.col("start") + size).alias("chars"))
    several = ends.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("part", "turns", "replies", "chars")).alias("parts"))
    cut = several.where("n > 1").select("conv_id", F.explode("parts").alias("x")).select("conv_id", "x.*")
    past = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"_{c}") for c in ("turns", "replies", "chars")])
    # a partition has two conversations that a border cuts, so there are at most two rows for each partition of in_order()
    joined = local.join(F.broadcast(bases), F.col("conv_id").eqNullSafe(F.col("_conv")) & (part() == F.col("_part")), "left")
    plus = lambda c, base: (F.col(c) + F.coalesce(F.col(base), F.lit(0))).alias(c)
    return joined.select("conv_id", "place", "piece", "reply_from", "reply_to", plus("turn_no", "_turns"), plus("example", "_replies"), plus("start", "_chars"))


def examples(table: DataFrame) -> DataFrame:
    """An example for each assistant turn: its number, the place before which pieces are its context, that context's turns and characters, and its target with the trainable part."""
    return table.where("reply_to IS NOT NULL").select("conv_id", "example", F.col("place").alias("before"), F.col("turn_no").alias("context_turns"), F.col("start").alias("context_chars"), F.col("piece").alias("target"), "reply_from", "reply_to")


def blocks(table: DataFrame, size: int = SLICE) -> DataFrame:
    """A written row for each block of each conversation: block, first (replies before it), text, and by reply in it: reply_from, reply_to and ends, that of its turn."""

    def run(batches):
        import pyarrow as pa

        last, rows, held, kind = None, [], 0, None

        def batch():
            made = [("".join(r[3]), *r) for r in rows]
            columns = [pa.array([r[1] for r in made], kind), *(pa.array([r[i] for r in made], pa.int64()) for i in (2, 3)), pa.array([r[0] for r in made], pa.string()), *(pa.array([r[i] for r in made], pa.list_(pa.int64())) for i in (5, 6, 7))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "block", "first", "text", "reply_from", "reply_to", "ends"])

        for b in in_slices(batches, 2):
            kind = b.column(0).type
            for conv, block, piece, example, a, z in zip(*(c.to_pylist() for c in b.columns[:6]), strict=True):
                if last != (conv, block):
                    if held > _BATCH:
                        yield batch()
                        held = 0
                    last, size_ = (conv, block), 0
                    rows.append((conv, block, example, [], [], [], []))
                _, _, _, texts, froms, tos, ends = rows[-1]
                texts.append(piece)
                if z is not None:
                    froms.append(size_ + a)
                    tos.append(size_ + z)
                    ends.append(size_ + len(piece))
                size_ += len(piece)
                held += len(piece)
        if rows:
            yield batch()

    cut = table.select("conv_id", F.floor(F.col("start") / size).alias("block"), "piece", "example", "reply_from", "reply_to", "place")
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "block", "place")]
    ordered = cut.repartition(shuffle_width(table.sparkSession), "conv_id", "block").sortWithinPartitions(*keys)
    conv = table.schema["conv_id"].dataType.simpleString()
    return written(ordered.mapInArrow(run, f"conv_id {conv}, block long, first long, text string, reply_from array<long>, reply_to array<long>, ends array<long>"), "blocks")


def expansion(table: DataFrame, size: int = SLICE) -> DataFrame:
    """The output, written: conv_id, example, slice, text, and in the text fresh_from, loss_from and loss_to.

    An example is the texts of its slices in order: its whole context and its target. Before
    fresh_from a slice has only what earlier examples have too; the loss is null where a slice has
    no target. Turns after the last reply have a null example.
    """

    def run(batches):
        import pyarrow as pa

        names = ["conv_id", "example", "slice", "text", "fresh_from", "loss_from", "loss_to"]
        made, held = [], 0

        def batch():
            columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), [kind, *[pa.int64()] * 2, pa.string(), *[pa.int64()] * 3], strict=True)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in in_slices(batches, 3):
            kind = b.column(0).type
            for conv, block, first, text, froms, tos, ends, replies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for example in range(first, replies):
                    own = example - first
                    if own < len(ends):
                        made.append((conv, example, block, text[: ends[own]], ends[own - 1] if own else 0, froms[own], tos[own]))
                    else:  # whole context of an example whose target is in a later block
                        made.append((conv, example, block, text, (ends[-1] if ends else 0) if own == len(ends) else len(text), None, None))
                    held += len(made[-1][3])
                    if held > _BATCH:
                        yield batch()
                        held = 0
                tail = ends[-1] if ends else 0
                if first + len(ends) == replies and tail < len(text):
                    made.append((conv, None, block, text[tail:], 0, None, None))
                    held += len(text) - tail
        if made:
            yield batch()

    found = blocks(table, size)
    through = F.col("first") + F.size("ends")
    # by conversation go only numbers, a row for each block; texts are dealt by block
    ends = found.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), F.max(through).over(Window.partitionBy("conv_id")).cast("long").alias("replies"))
    known = found.join(ends, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))).drop("_conv", "_block")
    conv = table.schema["conv_id"].dataType.simpleString()
    output = written(known.mapInArrow(run, f"conv_id {conv}, example long, slice long, text string, fresh_from long, loss_from long, loss_to long"), "examples")
    step_done(found)
    return output


def expanded(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """conv_id, example, text, and loss_from and loss_to in it, of the wanted rows of examples(): each one's slices as one text."""
    met = wanted.select(F.col("conv_id").alias("_conv"), F.col("example").alias("_example"), F.col("context_chars"), F.col("reply_from").alias("_from"), F.col("reply_to").alias("_to"))
    joined = met.join(expansion(table).select("conv_id", "example", "slice", "text"), F.col("_conv").eqNullSafe(F.col("conv_id")) & (F.col("_example") == F.col("example")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slice", "text"))), lambda x: x.text), "")
    out = joined.groupBy(F.col("_conv").alias("conv_id"), F.col("_example").alias("example"), "context_chars", "_from", "_to").agg(text.alias("text"))
    return out.select("conv_id", "example", "text", (F.col("context_chars") + F.col("_from")).alias("loss_from"), (F.col("context_chars") + F.col("_to")).alias("loss_to"))


def read_slices(output: DataFrame) -> DataFrame:
    """Every slice of the output, read: the text it adds, the loss in that, and length and checksum of its context before that.

    Slices that add nothing and are alike become one row with their number, times, as far as a task has them.
    """
    names = ["conv_id", "example", "slice", "added", "loss_from", "loss_to", "before", "crc", "times"]

    def run(batches):
        import pyarrow as pa

        kind, alike = None, {}

        def batch(rows):
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [kind, *[pa.int64()] * 2, pa.string(), *[pa.int64()] * 5], strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in in_slices(batches, 3):
            kind, rows = b.column(0).type, []
            for conv, example, block, text, fresh, a, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                crc, added = zlib.crc32(text[:fresh].encode()), text[fresh:]
                if added:
                    rows.append((conv, example, block, added, None if a is None else a - fresh, None if z is None else z - fresh, fresh, crc, 1))
                else:
                    alike[conv, block, fresh, crc] = alike.get((conv, block, fresh, crc), 0) + 1
            if len(alike) > 10_000:
                rows += [(conv, None, block, "", None, None, fresh, crc, n) for (conv, block, fresh, crc), n in alike.items()]
                alike.clear()
            if rows:
                yield batch(rows)
        if alike:
            yield batch([(conv, None, block, "", None, None, fresh, crc, n) for (conv, block, fresh, crc), n in alike.items()])

    conv = output.schema["conv_id"].dataType.simpleString()
    return output.mapInArrow(run, f"conv_id {conv}, example long, slice long, added string, loss_from long, loss_to long, before long, crc long, times long")


def read_back(output: DataFrame) -> DataFrame:
    """Digests of what the output's examples say, a row for each conversation. A context that isn't the conversation so far is a ValueError."""

    def run(batches):
        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "example_chars"]
        kind, last, state, done = None, None, None, []
        at, chars, crc = None, 0, 0

        def end():
            conv, n, turns, loss_chars, loss, size, replies, whole = state
            done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), size, replies, whole))

        def batch():
            columns = [pa.array(c, kind if i == 0 else None) for i, c in enumerate(zip(*done, strict=True))]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in in_slices(batches, 1):
            kind = b.column(0).type
            for conv, added, a, z, before, found, times, slice_, rest in zip(*(c.to_pylist() for c in b.columns[:9]), strict=True):
                if state is None or conv != last:
                    if state is not None:
                        end()
                    last, state, at = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0], None
                if at != slice_:
                    at, chars, crc = slice_, 0, 0
                if not rest and (before, found) != (chars, crc):
                    raise ValueError(f"an example's context is not its conversation so far: {conv}")
                for role, text in turns_in(added):
                    state[2].update(f"{role}\n{text}\n".encode())
                    state[1] += 1
                if z is not None:
                    reply = unescaped(added[a:z])
                    state[3] += len(reply)
                    state[4].update(reply.encode())
                    state[6] += 1
                chars, crc = chars + len(added), zlib.crc32(added.encode(), crc)
                size = (before + len(added)) * times
                state[5] += size
                state[7] += 0 if rest else size
            if done:
                yield batch()
        if state is not None:
            end()
            yield batch()

    # in a block: what examples add, then slices that add nothing, then what comes after the last reply
    rest = F.col("example").isNull() & (F.col("added") != "")
    late = F.when(rest, 2).when(F.col("added") == "", 1).otherwise(0)
    rows = read_slices(output).select("conv_id", "added", "loss_from", "loss_to", "before", "crc", "times", "slice", rest.alias("rest"), late.alias("late"), "example")
    ordered = each_conversation(rows, "slice", "late", "example")
    kind = output.schema["conv_id"].dataType.simpleString()
    digests = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, example_chars long"
    return ordered.mapInArrow(run, f"conv_id {kind}, {digests}")


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = conversations(spark, sf_dir).select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return read_back(expansion(formatted(table.unionByName(own))))
