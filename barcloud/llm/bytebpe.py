"""Byte-level BPE by dynamic programming over prefixes, and decoding.

The ids BPE gives for a byte string end with one certain token, and without it they are the ids of the
shorter prefix.  So for each prefix its unique last token is stored: the longest token that ends there
and is *compatible* with the last token of the prefix it leaves (two tokens are compatible if BPE
gives just these two for their concatenation).  Appending bytes computes only the new prefixes; after
an edit, prefixes before it are kept and those behind it are computed until they agree with the old
ones again for as long as the longest token.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from barcloud.llm.common import table, texts, with_arrow_columns
from barcloud.llm import prefixes
from barcloud.llm.tokens import PLAIN, PLAIN_LETTERS, PLAIN_NUMBERS, Memory, together

_RESULT = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType()),
])
_DIGESTS = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


class Ranks:
    """A vocabulary: bytes by id and back, and which tokens may follow each other."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.id_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {b: a for a, b in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        self._together = Memory(lambda pair: self.merge(pair[0] + pair[1]) == [pair[0], pair[1]])
        self._own = Memory(lambda token: self.merge(token) == [token])

    def merge(self, piece: bytes) -> list[bytes]:
        """BPE by its definition: the adjacent pair of least rank is merged, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.id_of.get(a + b) for a, b in zip(parts, parts[1:])]
            known = [r for r in ranks if r is not None]
            if not known:
                break
            at = ranks.index(min(known))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: bytes, token: bytes) -> bool:
        return self._together[before, token]

    def alone(self, token: bytes) -> bool:
        return self._own[token]


class Prefixes:
    """The last token of every prefix of ``data``; grows and changes with its data."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", [b""]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        while len(self.last) <= len(self.data):
            self.last.append(self._last_token(len(self.last)))

    def _last_token(self, end: int) -> bytes:
        ranks, data, last, known = self.ranks, self.data, self.last, self.ranks.id_of
        for start in range(max(0, end - ranks.longest), end):
            token = data[start:end]
            if token in known and (ranks.fits(last[start], token) if start else ranks.alone(token)):
                return token
        raise ValueError("a byte without a token")

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts ``new`` for ``data[start:stop]``; how many prefixes had to be computed again."""
        old, tail = self.last, len(self.data) - stop
        self.data = self.data[:start] + new + self.data[stop:]
        self.last, same, done = old[: start + 1], 0, 0
        while len(self.last) <= len(self.data):
            end = len(self.last)
            self.last.append(self._last_token(end))
            done += 1
            behind = len(self.data) - end
            if behind <= tail:
                # equal last tokens over the longest token's length: all that follows is equal too
                same = same + 1 if self.last[end] == old[len(old) - 1 - behind] else 0
                inside = end - same >= start + len(new)
                if same >= self.ranks.longest and inside:
                    self.last += old[len(old) - behind :] if behind else []
                    break
        return done

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token = self.last[end]
            out.append(self.ranks.id_of[token])
            end -= len(token)
        return out[::-1]


#: A single space between two other characters is taken into the match behind it, whatever they are.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_AT_EDGES = re.compile(r"\s | \s|^ | $")
#: White space for ``\s`` here, but not in the pattern's definition.
_CONTROL = re.compile("[\x1c-\x1f]")


#: What the public pattern finds in texts of plain characters.
_PLAIN_PIECES = re.compile(
    public_tokenizers.PATTERN.replace(r"\s\p{L}\p{N}", rf"\s{PLAIN_LETTERS}{PLAIN_NUMBERS}")
    .replace(r"\p{L}", f"[{PLAIN_LETTERS}]").replace(r"\p{N}", f"[{PLAIN_NUMBERS}]")
)
#: Pieces of more bytes are made one by one.
_LONG = 256


class ByteBPE:
    """Ids as little-endian unsigned 32-bit integers of each pattern match by itself, and bytes of ids."""

    def __init__(self, path: str, pattern: str):
        self.ranks = Ranks(path)
        by_rank = sorted(self.ranks.id_of.items(), key=lambda t: t[1])
        self._short = prefixes.Prefixes((token.decode("latin-1"), i) for token, i in by_rank)
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        exact = pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
        self._matches = regex.compile(exact).findall
        self._public = pattern == public_tokenizers.PATTERN
        self._pieces = Memory(lambda piece: next(self._made([piece])), share=0.5)
        self._spaced = Memory(lambda unit: next(self._after_space([unit])))

    def _made(self, pieces: list[str]) -> Iterator[bytes]:
        short, long = [], {}
        for piece in pieces:
            data = piece.encode("utf-8")
            if len(data) > _LONG:
                ids = Prefixes(self.ranks, data).ids()
                long[piece] = pack(f"<{len(ids)}I", *ids)
            else:
                short.append(data.decode("latin-1"))
        ids = iter(self._short.ids(short))
        return (long[piece] if piece in long else next(ids) for piece in pieces)

    def _units(self, matches: list[list[str]]) -> Iterator[bytes]:
        self._pieces.learn(set(chain.from_iterable(matches)), self._made)
        ids = self._pieces.__getitem__
        return (ids(own[0]) if len(own) == 1 else b"".join(map(ids, own)) for own in matches)

    def _after_space(self, units: list[str]) -> Iterator[bytes]:
        return self._units([[" " + u] if u.isascii() and u.isalpha() else self._matches(" " + u) for u in units])

    def encode(self, text: str | None) -> bytes:
        return next(self.every([text]))

    def every(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text; null is empty.  A single space inside a line starts a match, so units between spaces are looked up."""
        for some in together(texts):
            plain = [_PLAIN_PIECES.findall(t) if t and self._public and PLAIN.fullmatch(t) else None for t in some]
            split = [self._split(t) if t and own is None else [""] for t, own in zip(some, plain)]
            self._pieces.learn(set(chain.from_iterable(filter(None, plain))), self._made)
            firsts = list(self._units([self._matches(units[0]) for units in split]))
            self._spaced.learn(set(chain.from_iterable(units[1:] for units in split)), self._after_space)
            for own, first, units in zip(plain, firsts, split):
                if own is not None:
                    yield b"".join(map(self._pieces.__getitem__, own))
                else:
                    yield first + b"".join(map(self._spaced.__getitem__, units[1:]))

    def _split(self, text: str) -> list[str]:
        if _CONTROL.search(text):
            return [text]
        return _BETWEEN.split(text) if _AT_EDGES.search(text) else text.split(" ")

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple[str, str], ByteBPE] = {}


def byte_bpe(path: str, pattern: str) -> ByteBPE:
    """The encoder of ``path``, loaded once per Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(path, pattern)
    return _loaded[path, pattern]


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def round_trip(
    docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN,
    digests: bool = False,
) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` (little-endian unsigned 32 bit) and ``decoded`` bytes, or their SHA-256.

    Null text is empty; every row stays; columns of these names are replaced.
    """
    path = path or vocabulary()

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        bpe, counts, ids_out, decoded_out = byte_bpe(path, pattern), [], [], []
        for ids in bpe.every(texts(batch, text_col)):
            decoded = bpe.decode(ids)
            counts.append(len(ids) // 4)
            ids_out.append(hashlib.sha256(ids).hexdigest() if digests else ids)
            decoded_out.append(hashlib.sha256(decoded).hexdigest() if digests else decoded)
        names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
        kind = pa.string() if digests else pa.binary()
        return {"n_tokens": pa.array(counts, pa.int64()), names[0]: pa.array(ids_out, kind), names[1]: pa.array(decoded_out, kind)}

    return with_arrow_columns(docs, make, _DIGESTS if digests else _RESULT)


def op6_bpe_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
