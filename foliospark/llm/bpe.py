"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a byte string has exactly one BPE encoding, and all but its last token encode a shorter
prefix. So one number per prefix, its last token, holds all encodings: a candidate token ending at a position
is the right one if it can stand after the last token of the prefix before it. Appending continues the table;
an edit recomputes it from the edit until it agrees with the old table for as long as the longest token.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_columns

NEVER = 1 << 60
#: Pieces whose ids a worker remembers, twice so many at most, each of at most CACHED_CHARS characters.
CACHED_PIECES, CACHED_CHARS = 120_000, 40
#: Prefixes whose last token a worker remembers, of pieces of at most SHORT_BYTES; longer pieces have tables of their own.
CACHED_PREFIXES, SHORT_BYTES = 200_000, 80
#: Pairs of tokens that a worker remembers to be compatible or not.
CACHED_PAIRS = 200_000


class Vocabulary:
    """Ranks of byte strings, with the questions that the prefix table asks of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._compatible: dict[int, bool] = {}

    @classmethod
    def parse(cls, content: bytes) -> Vocabulary:
        """From the text of a rank file: base64 and rank on each line."""
        return cls({base64.b64decode(a): int(r) for a, r in (line.split() for line in content.splitlines() if line.strip())})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for one that no merge makes."""
        if token not in self._halves:
            parts = [self.rank[bytes([b])] for b in self.bytes_of[token]]
            while len(parts) > 2:
                best = min((self.rank.get(self.bytes_of[a] + self.bytes_of[b], NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best[0] >= token:
                    break
                parts[best[1] : best[1] + 2] = [best[0]]
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` together gives back just these two tokens.

        While each is being built, the tokens that touch the border are those on a's right and b's left flank.
        A merge over the border happens if its rank comes before the merge that takes either of the two away;
        of equal ranks the left one happens first.
        """
        known = self._compatible.get(a << 32 | b)
        if known is None:
            if len(self._compatible) >= CACHED_PAIRS:
                self._compatible.clear()
            known = self._compatible[a << 32 | b] = self._grow_apart(a, b)
        return known

    def _grow_apart(self, a: int, b: int) -> bool:
        x, y, x_goes, y_goes = a, b, NEVER, NEVER
        while True:
            across = self.rank.get(self.bytes_of[x] + self.bytes_of[y], NEVER)
            if across < x_goes and across <= y_goes and across < NEVER:
                return False
            left, right = self.halves(x), self.halves(y)
            if left and (not right or x > y):
                x, x_goes = left[1], x
            elif right:
                y, y_goes = right[0], y
            else:
                return True


class PrefixTable:
    """The last token of every prefix of a byte string that can be appended to and edited."""

    def __init__(self, vocabulary: Vocabulary, content: bytes = b""):
        self.vocabulary, self.content, self.last = vocabulary, b"", [-1]
        self.append(content)

    def append(self, more: bytes) -> None:
        start, self.content = len(self.content), self.content + more
        self.last.extend(self._fill(start, len(self.content)))

    def _token(self, end: int) -> int:
        rank, content, last, ok = self.vocabulary.rank, self.content, self.last, self.vocabulary.compatible
        for start in range(max(0, end - self.vocabulary.longest), end):
            token = rank.get(content[start:end])
            if token is not None and (start == 0 or ok(last[start], token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def _fill(self, start: int, stop: int):
        for end in range(start + 1, stop + 1):
            yield self._token(end)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of the bytes from start to stop; returns how many positions were computed again."""
        tail = self.last[stop + 1 :]
        self.content = self.content[:start] + new + self.content[stop:]
        del self.last[start + 1 :]
        resume, agreed = start + len(new), 0
        for end in range(start + 1, len(self.content) + 1):
            token = self._token(end)
            self.last.append(token)
            if end > resume:
                agreed = agreed + 1 if token == tail[end - resume - 1] else 0
                # Each later entry looks at so many bytes and entries before it, all of them as they were.
                if agreed >= self.vocabulary.longest:
                    self.last.extend(tail[end - resume :])
                    return end - start
        return len(self.content) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.content)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes_of[self.last[end]])
        return out[::-1]


class Codec:
    """Texts to ids and back: a pattern splits the text, each piece is encoded for itself.

    A prefix's last token hangs on the prefix alone, so pieces that begin alike share one table of prefixes.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pieces = vocabulary, regex.compile(pattern).findall
        self._cache: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        self._last: dict[bytes, int] = {}

    def last(self, prefix: bytes) -> int:
        """The last token of a short prefix; only the prefixes that the search comes by are filled in."""
        known, rank, ok = self._last, self.vocabulary.rank, self.vocabulary.compatible
        for start in range(max(0, len(prefix) - self.vocabulary.longest), len(prefix)):
            token = rank.get(prefix[start:])
            if token is not None:
                before = prefix[:start]
                if not start or ok(known[before] if before in known else self.last(before), token):
                    known[prefix] = token
                    return token
        raise ValueError("the vocabulary lacks a byte")

    def _short(self, raw: bytes) -> tuple[int, ...]:
        if len(self._last) >= CACHED_PREFIXES:
            self._last.clear()
        out = []
        while raw:
            token = self._last[raw] if raw in self._last else self.last(raw)
            out.append(token)
            raw = raw[: -len(self.vocabulary.bytes_of[token])]
        return tuple(out[::-1])

    def piece(self, piece: str) -> tuple[int, ...]:
        ids = self._older.get(piece) or self._fresh(piece.encode())
        if len(piece) <= CACHED_CHARS:
            if len(self._cache) >= CACHED_PIECES:
                self._cache, self._older = {}, self._cache
            self._cache[piece] = ids
        return ids

    def _fresh(self, raw: bytes) -> tuple[int, ...]:
        whole = self.vocabulary.rank.get(raw)
        if whole is not None:
            return (whole,)
        return self._short(raw) if len(raw) <= SHORT_BYTES else tuple(PrefixTable(self.vocabulary, raw).tokens())

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self._cache.get
        for piece in self.pieces(text):
            out += known(piece) or self.piece(piece)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


def little_endian(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    held = array("I", ids)
    if held.itemsize != 4:
        held = array("L", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


@lru_cache(maxsize=4)
def _codec(content: bytes, pattern: str) -> Codec:
    """One for a worker process, kept from task to task."""
    return Codec(Vocabulary.parse(content), pattern)


def encode_texts(df: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Each row with ``n_tokens``, ``ids`` (array<int>, unless with_ids is false), ``ids_sha256`` and ``decoded_sha256``.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the bytes that the ids decode to.
    A null text is an empty one: no ids, the digests of no bytes. Rows are independent, so repeated rows and
    ids give equal results, an empty table gives an empty one, and other columns pass unless they have one of
    the new names. The driver reads the vocabulary (a file of bounded size) and sends it with the tasks.
    """
    with open(vocabulary_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def digest(texts: list) -> dict[str, list]:
        codec = _codec(shared.value, pattern)
        out: dict[str, list] = {"n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": []}
        for value in texts:
            ids = codec.encode(value or "")
            out["n_tokens"].append(len(ids))
            out["ids"].append(ids if with_ids else None)
            out["ids_sha256"].append(hashlib.sha256(little_endian(ids)).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return out

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_columns(df, [text], digest, T.StructType([f for f in fields if with_ids or f.name != "ids"]), keep)
