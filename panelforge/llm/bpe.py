"""Byte-level BPE by backtracking over longest matches, and decoding by an offset table.

One Aho-Corasick pass over a word's bytes finds the longest token at each place. Tokens are
then laid down from the left: a token may follow another only if merging the two tokens'
bytes gives back just these two, which a table of compatible pairs tells. Where nothing fits
the last token is taken back and its next shorter prefix tried; places found hopeless are not
tried again, so the work is linear in the word's length. The one sequence whose neighbours
are all compatible is what the merges give.

Null text is empty and has no ids. A text of any length is handled whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from panelforge.llm.common import documents, lone, map_values
from panelforge.llm.encoding import KEPT, ROOMY, ChunkEncoder, as_array

VOCABULARY = "byte_bpe_50k.json"


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return {b: chr(b if b in plain else next(extra)) for b in range(256)}


class Backtracker:
    """Ids of one word's bytes, and bytes of ids."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        back = {letter: byte for byte, letter in byte_letters().items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        words = {i: bytes(back[c] for c in token) for token, i in vocab.items() if token not in self.special}
        words |= {i: content.encode() for content, i in self.special.items()}
        self.size = max(words) + 1
        #: Offset table: token i is blob[starts[i] : starts[i] + lengths[i]].
        self.lengths = np.array([len(words.get(i, b"")) for i in range(self.size)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(words.get(i, b"") for i in range(self.size)), np.uint8)
        self.length = self.lengths.tolist()
        self.names = np.array([str(i) for i in range(self.size)], object)
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = vocab[left], vocab[right], vocab.get(left + right)
            self.rank[a, b] = rank
            self.halves.setdefault(whole, (rank, a, b))
        self.single = [vocab[byte_letters()[b]] for b in range(256)]
        reachable = {*self.single, *self.halves}
        self.machine = ahocorasick.Automaton()
        by_bytes = {words[i]: i for i in reachable}
        for word, i in by_bytes.items():
            self.machine.add_word(word.decode("latin-1"), i)
        self.machine.make_automaton()
        #: The longest token that is a proper prefix of a token, or -1.
        self.shorter = {i: next((by_bytes[w[:n]] for n in range(len(w) - 1, 0, -1) if w[:n] in by_bytes), -1) for w, i in by_bytes.items()}
        self.whole = by_bytes
        self.fits = lru_cache(1 << 16)(self._fits)

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging never joins a's last part with b's first part.

        Both tokens are undone from their latest merge on. A pair of parts that stand at the
        same time is joined if its merge comes before the merge that uses up either part; at
        equal rank the left one comes first.
        """
        until_a = until_b = len(self.rank) + 1
        while True:
            rank = self.rank.get((a, b))
            if rank is not None and rank < until_a and rank <= until_b:
                return False
            made_a, left_b = self.halves.get(a), self.halves.get(b)
            if made_a is None and left_b is None:
                return True
            if made_a is None or (left_b is not None and left_b[0] >= made_a[0]):
                until_b, b = left_b[0], left_b[1]
            else:
                until_a, a = made_a[0], made_a[2]

    def word(self, data: bytes) -> list[int]:
        if (i := self.whole.get(data)) is not None and self._alone(i):
            return [i]
        n = len(data)
        longest = [self.single[b] for b in data]
        length = self.length
        for end, i in self.machine.iter(data.decode("latin-1")):
            longest[end - length[i] + 1] = i  # later ends are longer
        hopeless: set[int] = set()
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            after = at + length[token]
            if after not in hopeless and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = after
                if at < n:
                    token = longest[at]
                continue
            token_shorter = self.shorter[token]
            if token_shorter >= 0:
                token = token_shorter
            else:
                hopeless.add(at)
                token = out.pop()
                at -= length[token]
        return out

    def _alone(self, i: int) -> bool:
        """Whether the token's own bytes merge back into it."""
        made = self.halves.get(i)
        return made is None or (self.fits(made[1], made[2]) is False and self._alone(made[1]) and self._alone(made[2]))

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        place = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.blob[place].tobytes()



def coder(path: str, kept: int = KEPT) -> tuple[Backtracker, ChunkEncoder]:
    """The worker's tables of the file at path, and their encoder, which keeps that many chunks."""
    return lone(f"bpe {path} {kept}", lambda: _coder(Backtracker(path), kept))


def _coder(bpe: Backtracker, kept: int = KEPT) -> tuple[Backtracker, ChunkEncoder]:
    words = regex.compile(public_tokenizers.PATTERN)
    special = regex.compile("(" + "|".join(map(regex.escape, bpe.special)) + ")") if bpe.special else None
    pack = [i.to_bytes(4, "little") for i in range(bpe.size)].__getitem__

    def encode(chunks: list[str]) -> list[bytes]:
        out = []
        for chunk in chunks:
            if chunk in bpe.special:
                ids = [bpe.special[chunk]]
            else:
                ids = [i for w in words.findall(chunk) for i in bpe.word(w.encode())]
            out.append(b"".join(map(pack, ids)))
        return out

    def loose(text: str) -> list[str]:
        """Words, with the special tokens' strings as pieces of their own."""
        parts = special.split(text) if special else [text]
        return [w for p in parts if p for w in ([p] if p in bpe.special else words.findall(p))]

    return bpe, ChunkEncoder(encode, True, loose, tuple(bpe.special), kept)


def _whole(path: str, kept: int = KEPT) -> Callable[[list], list[list]]:
    """n_tokens, ids and decoded of texts."""

    def run(texts: list) -> list[list]:
        bpe, encoder = coder(path, kept)
        ids = encoder.all_ids([t or "" for t in texts])
        return [[len(i) // 4 for i in ids], ids, [bpe.decode(as_array(i)) for i in ids]]

    return run


def encoded(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (little-endian unsigned 32-bit), decoded (the ids' text in UTF-8)."""
    return map_values(df, [key], text, "n_tokens bigint, ids binary, decoded binary", _whole(path))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what encoded() gives, made by the worker that holds the tables, which a step of its own would drive out."""
    path = public_tokenizers.path(VOCABULARY)
    whole = _whole(path, ROOMY)

    def digests(texts: list) -> list[list]:
        n, ids, decoded = whole(texts)
        names = coder(path, ROOMY)[0].names
        decimals = [hashlib.sha256(",".join(names[as_array(i)]).encode()).hexdigest() for i in ids]
        return [n, decimals, [hashlib.sha256(d).hexdigest() for d in decoded]]

    return map_values(documents(spark, sf_dir), ["doc_id"], "text", "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digests)
