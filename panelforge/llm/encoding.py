"""Token ids of whole texts, chunk by chunk with a bounded memory of chunks.

A text is cut where a blank is followed by a character that is not white space. No token of
the tokenizers used here crosses such a cut, so a chunk's ids don't depend on its neighbours,
and chunks come again and again. What the chunks of many texts lack is learned together. The
memory of chunks has a limit; what has not been asked for lately goes first.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Callable

import numpy as np

from panelforge.llm.common import lone

#: Chunks whose ids a worker keeps: about 200 bytes each. A query that holds nothing else keeps ROOMY.
KEPT, ROOMY = 400_000, 1_500_000
#: Texts whose chunks are looked up and learned together.
TOGETHER = 32
#: A blank after which no chunk starts.
_LOOSE = re.compile(r" (?=\s|\Z)")
#: Letters that keep their meaning beside any punctuation, marks, and the same on a next line.
#: Marks are ASCII's without the apostrophe, which may begin a word of its own with letters after it.
_L, _M = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf"([{_L}]+)([{_M}]*)(?:\n([{_L}]+)([{_M}]*))?").fullmatch


class Memory:
    """Ids of chunks in two generations of half the limit each.

    What is asked for and stands in the elder one comes over to the younger. Once that is full it
    becomes the elder, and what nobody asked for since then goes.
    """

    def __init__(self, limit: int):
        self.half = limit // 2
        self.young: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}

    def make_room(self, n: int) -> None:
        """If n more would not fit, the younger generation becomes the elder."""
        if self.young and len(self.young) + n > self.half:
            self.young, self.elder = {}, self.young

    def lacking(self, wanted: set[str]) -> set[str]:
        """Those of wanted that neither generation has; the others are in the younger after that."""
        out, young, elder = set(), self.young, self.elder.pop
        for p in wanted:
            if p not in young:
                if (ids := elder(p, None)) is None:
                    out.add(p)
                else:
                    young[p] = ids
        return out


class ChunkEncoder:
    """Ids of texts by encode(chunks) -> little-endian unsigned 32-bit ids of each chunk.

    glued: chunks after a text's first keep their blank (byte-level vocabularies), and lines
    have ids of their own. fold: makes words alike that the vocabulary doesn't tell apart.
    loose: cuts a text where plain splitting is wrong; its pieces join to the text. special:
    strings whose presence makes a text loose. words(words, blank): as encode, for words of
    letters, each after a blank if blank is set.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], glued: bool, loose: Callable[[str], list[str]], special: tuple[str, ...], limit: int = KEPT, words: Callable | None = None, fold: Callable[[str], str] = str):
        self.encode, self.glued, self.loose, self.special, self.fold = encode, glued, loose, special, fold
        self.words = words or (lambda found, blank: encode([blank + w for w in found]))
        self.inner = Memory(limit)
        self.spaced = Memory(limit) if glued else self.inner
        self.marks: dict[str, bytes] = {}
        self.line = encode(["\n"])[0] if glued else b""

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self.all_ids([text])[0]

    def all_ids(self, texts: list[str]) -> list[bytes]:
        """ids() of each text."""
        collects = gc.isenabled()
        gc.disable()  # nothing here has cycles, and the collector would walk through what is in hand time and again
        try:
            return [ids for at in range(0, len(texts), TOGETHER) for ids in self._together(texts[at : at + TOGETHER])]
        finally:
            if collects:
                gc.enable()

    def _together(self, texts: list[str]) -> list[bytes]:
        first, after = [], []
        for text in texts:
            if _LOOSE.search(text) or any(s in text for s in self.special):
                first.append(self.loose(text))
                after.append([])
                continue
            parts = text.split(" ")
            cut = 1 if self.glued else len(parts)
            first.append(parts[:cut] if parts[0] else parts[1:cut])
            after.append(parts[cut:])
        found = self._many(first, self.inner, "")
        return [a + b for a, b in zip(found, self._many(after, self.spaced, " "), strict=True)] if self.glued else found

    def _many(self, lists: list[list[str]], known: Memory, blank: str) -> list[bytes]:
        found = [list(map(known.young.get, parts)) for parts in lists]
        gaps = []
        for parts, ids in zip(lists, found, strict=True):
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                gaps.append((ids, at, parts[at]))
        if gaps:
            wanted = {p for _, _, p in gaps}
            known.make_room(3 * len(wanted))
            once = self._learn(known.lacking(wanted), known, blank)
            for ids, at, p in gaps:
                ids[at] = once[p] if p in once else known.young[p]
        return list(map(b"".join, found))

    def _learn(self, missing: set[str], known: Memory, blank: str) -> dict[str, bytes]:
        """Learns what is missing; the ids of chunks that are not kept, as their word is new too."""
        plain, other, stems, below, marks = [], [], set(), set(), set()
        for p in missing:
            if m := _PLAIN(p):
                one, mark, two, mark2 = m.groups("")
                one, two = self.fold(one), self.fold(two)
                plain.append((p, one, mark, two, mark2))
                stems.add(one)
                if two:
                    below.add(two)
                marks.update((mark, mark2))
            else:
                other.append(p)
        marks.discard("")
        if not self.glued:
            stems, below = stems | below, set()
        elif known is not self.inner:
            self.inner.make_room(len(below))
        stems = known.lacking(stems)
        below = self.inner.lacking(below)
        if len(self.marks) > 10_000:
            self.marks.clear()
        new_marks = [m for m in marks if m not in self.marks]
        self._add(list(stems), known.young, lambda new: self.words(new, blank))
        self._add(list(below), self.inner.young, lambda new: self.words(new, ""))
        self._add(new_marks, self.marks, self.encode)
        self._add(other, known.young, lambda new: self.encode([blank + p for p in new]))
        once = {"": b""}
        for p, one, mark, two, mark2 in plain:
            ids = known.young[one] + (self.marks[mark] if mark else b"")
            if two:
                ids += self.line + self.inner.young[two] + (self.marks[mark2] if mark2 else b"")
            (once if two or (mark and one in stems) else known.young)[p] = ids
        return once

    @staticmethod
    def _add(new: list[str], known: dict[str, bytes], make: Callable[[list[str]], list[bytes]]) -> None:
        if new:
            known.update(zip(new, make(new), strict=True))


def _cut(ids: np.ndarray, starts: np.ndarray, n: int) -> list[bytes] | None:
    """The ids between starts, if there are n."""
    if len(starts) != n:
        return None
    whole, edges = ids.tobytes(), (4 * np.append(starts, len(ids))).tolist()
    return [whole[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def library_encoder(path: str, glued: bool, kept: int = KEPT) -> ChunkEncoder:
    """The worker's encoder of the file at path, which keeps that many chunks."""
    return lone(f"encoder {path} {glued} {kept}", lambda: _library_encoder(path, glued, kept))


def _library_encoder(path: str, glued: bool, kept: int = KEPT) -> ChunkEncoder:
    """Chunks encoded by the tokenizers library from the file at path.

    Many chunks go to the library as one text. Words are told apart again by the tokens that
    begin with a blank or end a word; other chunks by a special token set between them, which
    the library cuts out before anything else. Words of letters are normal already and parted
    by blanks alone, so they need neither the normalizer nor the library's pattern, and as each
    comes once, no memory of the library's own.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    comma, mark = next(iter(special.items()))
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    edge = np.array([n.startswith("\u0120") if glued else n.endswith("</w>") for n in names])
    with open(path, encoding="utf-8") as file:
        model = {k: v for k, v in json.load(file)["model"].items() if k != "type" and v is not None}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.pop("merges")]
    tokenizer.model = models.BPE(model.pop("vocab"), merges, cache_capacity=0, **model)
    plain = Tokenizer(tokenizer.model)
    parted = pre_tokenizers.Split(" ", "merged_with_next") if glued else pre_tokenizers.WhitespaceSplit()
    plain.pre_tokenizer = pre_tokenizers.Sequence([parted, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def whole(text: str, by: Tokenizer = tokenizer) -> np.ndarray:
        return np.array(by.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def encode(chunks: list[str]) -> list[bytes]:
        if not chunks:
            return []
        if any(s in c for c in chunks if "<" in c for s in special):
            return [whole(c).tobytes() for c in chunks]
        ids = whole(comma.join(chunks))
        ends = [*np.flatnonzero(ids == mark).tolist(), len(ids)]
        data, starts = ids.tobytes(), [0, *(e + 1 for e in ends[:-1])]
        return [data[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]

    def words(found: list[str], blank: str) -> list[bytes]:
        if glued and not blank:
            return encode(found)
        ids = whole(blank + " ".join(found), plain)
        starts = np.flatnonzero(edge[ids]) if glued else np.append(0, np.flatnonzero(edge[ids])[:-1] + 1)
        return _cut(ids, starts, len(found)) or encode([blank + w for w in found])

    return ChunkEncoder(encode, glued, lambda text: [text], tuple(special), kept, words=words, fold=str if glued else str.lower)


def as_array(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")
