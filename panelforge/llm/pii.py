"""Personal data: patterns propose spans, checksums confirm them, context moves the score.

Everything is a Spark SQL expression on one row, so there is no shuffle and no Python worker.
Positions come from splitting a text at a pattern's matches: the lengths of the gaps and of
the matches give each match's place in code points.

Secrets are runs of 32 to 128 letters and digits beside a word such as token or password.

Null text counts as empty; an empty text has no spans; a text of any length is searched whole; repeated rows give repeated results;
an empty table gives an empty table. Only the two named columns are read, so further columns
of any name are carried along untouched by ``detect``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import documents, quoted

_LOCAL = "A-Za-z0-9._%+-"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    hint: a cheap test that a text must pass before the pattern runs. base: the span stays
    whatever its score. score: before context. words: context that adds CONTEXT_GAIN.
    """

    name: str
    pattern: str
    hint: str
    confirm: str
    score: float
    words: str
    base: bool = True


CONTEXT_BEFORE, CONTEXT_AFTER, CONTEXT_GAIN, THRESHOLD = 40, 20, 0.35, 0.6
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length(d)), 0, (a, i) -> a + "
    "(CASE WHEN i % 2 = 1 THEN int(substring(d, -i, 1)) "
    "ELSE int(substring(d, -i, 1)) * 2 - (CASE WHEN substring(d, -i, 1) >= '5' THEN 9 ELSE 0 END) END)) % 10 = 0"
)
_MOD97 = (
    "aggregate(sequence(1, length(c)), 0, (a, i) -> "
    "(CASE WHEN substring(c, i, 1) BETWEEN '0' AND '9' THEN (a * 10 + int(substring(c, i, 1))) % 97 "
    "ELSE (a * 100 + ascii(substring(c, i, 1)) - 55) % 97 END)) = 1"
)


def _let(name: str, value: str, body: str) -> str:
    """body with name bound to value, computed once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Matches start at a run's first character or where the last match ended: nothing else can
#: start a leftmost match, and a long run is then read once.
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains({t}, '@')", "true", 0.9, "mail|contact|write|correo"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "{t} rlike '[0-9][.][0-9]'", rf"m rlike '^{_PART}(?:[.]{_PART}){{3}}$'", 0.6, r"\\b(?:ip|host|server|address|login)\\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "{t} rlike '[0-9][ -]?[0-9]'", _let("d", _DIGITS, f"length(d) BETWEEN 12 AND 19 AND {_LUHN}"), 0.7, "card|visa|credit|tarjeta|karte|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "{t} rlike '[+][0-9]'", f"length({_DIGITS}) BETWEEN 9 AND 15", 0.6, "phone|tel|call|mobil|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "{t} rlike '[A-Z][A-Z][0-9][0-9]'", _let("w", "replace(m, ' ', '')", "length(w) BETWEEN 15 AND 34 AND " + _let("c", "concat(substring(w, 5), left(w, 4))", _MOD97)), 0.9, "iban|account|bank|konto|cuenta", False),
    Kind("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "{t} rlike '[0-9]-[0-9][0-9]-[0-9]'", "left(m, 3) NOT IN ('000', '666') AND left(m, 1) <> '9' AND substring(m, 5, 2) <> '00' AND right(m, 4) <> '0000'", 0.4, "ssn|social|security|tax", False),
    Kind("local_phone", r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z-])", "{t} rlike '[0-9][-. ][0-9]{{4}}'", "true", 0.4, "phone|tel|call|mobil|fax", False),
    Kind("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,128}+(?![A-Za-z0-9+/_-])", "{t} rlike '[A-Za-z0-9+/_-]{{32}}'", "m rlike '[0-9]' AND m rlike '[A-Za-z]'", 0.4, "token|secret|passw|api.?key|access.?key|private.?key|bearer|credential", False),
)

_BLOCK = 64


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _found(kind: Kind, rank: int, text: str) -> str:
    """SQL for the kind's confirmed spans of text, an array of structs that sorts by place.

    The running sum of lengths goes by blocks of _BLOCK matches, so a text that is one
    match after another costs little more than its length.
    """
    step = "length(p[i]) + length(ms[i])"
    start = f"off[i div {_BLOCK}] + aggregate(slice(st, (i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK}), 0, (a, x) -> a + x) + length(p[i])"
    near = f"lower(concat(right(p[i], {CONTEXT_BEFORE}), ' ', left(p[i + 1], {CONTEXT_AFTER})))"
    one = _let(
        "s",
        start,
        f"named_struct('start', s, 'rank', {rank}, 'kind', '{kind.name}', 'end', s + length(ms[i]), "
        f"'score', least(1D, {kind.score}D + CASE WHEN {near} rlike '{kind.words}' THEN {CONTEXT_GAIN}D ELSE 0D END), "
        f"'base', {str(kind.base).lower()}, 'value', ms[i])",
    )
    good = f"transform(array(ms[i]), m -> {kind.confirm})[0]"
    places = f"transform(filter(sequence(0, size(ms) - 1), i -> {good}), i -> {one})"
    sums = _let("tot", f"transform(sequence(0, (size(ms) - 1) div {_BLOCK}), b -> aggregate(slice(st, b * {_BLOCK} + 1, {_BLOCK}), 0, (a, x) -> a + x))", "transform(sequence(0, size(tot) - 1), b -> aggregate(slice(tot, 1, b), 0, (a, x) -> a + x))")
    whole = _let("st", f"transform(sequence(0, size(ms) - 1), i -> {step})", _let("off", sums, places))
    empty = f"filter(array({_EMPTY}), x -> false)"
    split = _let("p", f"split({text}, {_literal(kind.pattern)}, -1)", whole)
    matches = _let("ms", f"regexp_extract_all({text}, {_literal(kind.pattern)}, 0)", f"CASE WHEN size(ms) = 0 THEN {empty} ELSE {split} END")
    kept = "true" if kind.base else f"x.score >= {THRESHOLD}D"
    return f"CASE WHEN {kind.hint.format(t=text)} THEN filter({matches}, x -> {kept}) ELSE {empty} END"


_EMPTY = "named_struct('start', 0, 'rank', 0, 'kind', '', 'end', 0, 'score', 0D, 'base', false, 'value', '')"


def detect(df: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """df with the spans of every text: start, end (code points), kind, score, base, value.

    Sorted by start, then by kind as in KINDS. An existing column called out is replaced.
    """
    body = f"coalesce({quoted(text)}, '')"
    arrays = ", ".join(_found(kind, rank, body) for rank, kind in enumerate(KINDS))
    return df.withColumn(out, F.expr(f"sort_array(concat({arrays}))"))


def redacted(text: str, spans: str) -> Column:
    """text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    t, s = f"coalesce({quoted(text)}, '')", quoted(spans)
    cut = f"array(substring({t}, a.pos + 1, x.start - a.pos), concat('<', upper(x.kind), '>'))"
    step = (
        f"CASE WHEN x.start >= a.pos THEN named_struct('pos', x.end, 'out', concat(a.out, {cut})) "
        f"ELSE named_struct('pos', greatest(a.pos, x.end), 'out', a.out) END"
    )
    whole = f"aggregate({s}, named_struct('pos', 0, 'out', cast(array() AS array<string>)), (a, x) -> {step}, a -> concat(array_join(a.out, ''), substring({t}, a.pos + 1)))"
    return F.expr(f"CASE WHEN size({s}) = 0 THEN {quoted(text)} ELSE {whole} END")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(documents(spark, sf_dir).select("doc_id", "text"))
    named = "concat_ws(':', x.kind, x.start, x.end)"
    joined = lambda keep: F.expr(f"array_join(transform(filter(pii_spans, x -> {keep}), x -> {named}), ',')")
    counts = [F.expr(f"bigint(size(filter(pii_spans, x -> x.kind = '{k.name}')))").alias(f"n_{k.name}") for k in KINDS if k.base]
    return found.select("doc_id", *counts, F.sha2(joined("x.base"), 256).alias("base_sha256"), joined("true").alias("spans"))
