"""Names without marks, by the whole compatibility decomposition of Unicode, as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Composed Hangul, which decomposes by a rule into letters that no name key keeps.
HANGUL = range(0xAC00, 0xD7A4)


@lru_cache(1)
def _tables() -> tuple[str, str, dict[str, str]]:
    """Letters that become one letter, these, then combining marks that go; and what becomes several letters."""
    single, plain, marks, several = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if code in HANGUL or 0xD800 <= code < 0xE000:
            continue
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not bare:
            marks.append(c)
        elif bare != c:
            if len(bare) == 1:
                single.append(c)
                plain.append(bare)
            else:
                several[c] = bare
    return "".join(single) + "".join(marks), "".join(plain), several


def unmarked(c: Column) -> Column:
    """NFKD without combining marks; composed Hangul stays. Rows without letters of several parts pass one lookup."""
    gone, plain, several = _tables()
    one = F.translate(c, gone, plain)
    pairs = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spread = F.array_join(F.transform(F.split(one, ""), lambda x: F.coalesce(F.try_element_at(pairs, x), x)), "")
    return F.when(F.translate(one, "".join(several), "") == one, one).otherwise(spread)


def name_key(c: Column, suffixes: Sequence[str], aliases: Mapping[str, str]) -> Column:
    """Without marks, in lower case, single blanks for _, - and white space, no apostrophes, no region's suffix, known aliases put right."""
    one = F.trim(F.regexp_replace(F.translate(F.lower(unmarked(c)), "_-'", "  "), r"(?U)\s+", " "))
    short = F.trim(F.regexp_replace(one, rf"\s(?:{'|'.join(suffixes)})$", "")) if suffixes else one
    if not aliases:
        return short
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), short), short)


def ascii_key(c: Column, suffixes: Sequence[str]) -> Column:
    """Lower case, ASCII only, without a last word that is a region's, all other signs as single blanks; NULL is empty."""
    low = F.regexp_replace(unmarked(F.lower(F.trim(c))), r"[^\x00-\x7F]", "")
    short = F.regexp_replace(low, rf"\b({'|'.join(suffixes)})\b$", "")
    return F.coalesce(F.trim(F.regexp_replace(short, "[^a-z0-9]+", " ")), F.lit(""))
