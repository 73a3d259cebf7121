"""Last tokens of all prefixes of many short byte-pair sequences together, in NumPy.

The ids BPE gives for a sequence end with one certain token: the longest that ends there and is *compatible* with the
last token of the prefix it leaves (BPE gives just these two for their concatenation).  All sequences move one symbol at a time;
the tokens that may end at a symbol come from a trie.  Two tokens are compatible if, undoing their merges from the latest to
the first, no two neighbours across their border have a merge that would have come before; tried once, a pair is
kept in a table of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SYMBOL_BITS = 9
_PAIR_SLOTS = 18
#: Symbols that are worked on at once.
_SYMBOLS = 1 << 17


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(np.uint64) * _MIX >> np.uint64(64 - bits)).astype(np.int64)


class _Hash:
    """Numbers by key, open addressing; -1 for other keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot = _slots(keys, self.bits)
        while len(keys):
            free, at = np.unique(slot, return_index=True)
            at = at[self.keys[free] < 0]
            self.keys[slot[at]], self.values[slot[at]] = keys[at], values[at]
            left = np.ones(len(keys), bool)
            left[at] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (len(self.keys) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = _slots(keys, self.bits)
        out, held = self.values[slot], self.keys[slot]
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        out[held != keys] = -1
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & (len(self.keys) - 1)
            held, own = self.keys[slot], keys[open_]
            out[open_] = np.where(held == own, self.values[slot], -1)
            more = (held != own) & (held >= 0)
            open_, slot = open_[more], slot[more]
        return out


class Prefixes:
    """``ids(sequences)``: symbols are the code points (below 512) of ``str``; tokens are given in the order of their merges."""

    def __init__(self, tokens: Iterable[tuple[str, int]]):
        tokens = sorted(tokens, key=lambda t: len(t[0]) > 1)  # single symbols first; stable
        self._pairs: dict[int, int] = {}
        self._left, self._right = list(range(len(tokens))), list(range(len(tokens)))
        number: dict[str, int] = {}
        for t, (text, _) in enumerate(tokens):
            if len(text) > 1:
                halves = self._halves(text, number)
                if halves is None:  # no text gives this token
                    continue
                self._left[t], self._right[t] = halves
                self._pairs[halves[0] << 32 | halves[1]] = t
            number[text] = t
        self._ids = np.array([i for _, i in tokens], np.uint32)
        self._sizes = np.array([len(text) for text, _ in tokens], np.int32)
        self._grow(number)
        self._known = np.full(1 << _PAIR_SLOTS, -1, np.int64)
        self._fits = np.zeros(1 << _PAIR_SLOTS, bool)

    def _halves(self, text: str, number: dict[str, int]) -> tuple[int, int] | None:
        for k in range(1, len(text)):
            a, b = number.get(text[:k]), number.get(text[k:])
            if a is not None and b is not None and self.compatible(a, b):
                return a, b
        return None

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens ``a`` and ``b`` (numbers) side by side."""
        limit, pairs, left, right = 1 << 40, self._pairs, self._left, self._right
        while True:
            if pairs.get(a << 32 | b, limit) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def _grow(self, number: dict[str, int]) -> None:
        nodes: dict[int, int] = {}
        token_at = [-1]
        for text, t in number.items():
            node = 0
            for symbol in map(ord, text):
                key = node << _SYMBOL_BITS | symbol
                node = nodes.get(key, 0)
                if not node:
                    node = nodes[key] = len(token_at)
                    token_at.append(-1)
            token_at[node] = t
        self._token_at = np.array(token_at, np.int32)
        self._next = _Hash(np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int32, len(nodes)))
        self._first = np.array([nodes.get(s, -1) for s in range(1 << _SYMBOL_BITS)], np.int32)

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        slot = _slots(keys, _PAIR_SLOTS)
        out = self._fits[slot]
        new = np.flatnonzero(self._known[slot] != keys)
        if len(new):
            some, at = np.unique(keys[new], return_inverse=True)
            fits = np.array([self.compatible(k >> 32, k & 0xFFFFFFFF) for k in some.tolist()], bool)
            out[new] = fits[at]
            slot = _slots(some, _PAIR_SLOTS)
            slot, first = np.unique(slot, return_index=True)
            self._known[slot], self._fits[slot] = some[first], fits[first]
        return out

    def ids(self, sequences: list[str]) -> list[bytes]:
        """The ids of each sequence as little-endian unsigned 32-bit integers."""
        out, at, size = [], 0, 0
        for i, sequence in enumerate(sequences):
            if size + len(sequence) > _SYMBOLS and i > at:
                out += self._some(sequences[at:i])
                at, size = i, 0
            size += len(sequence)
        return out + self._some(sequences[at:])

    def _some(self, sequences: list[str]) -> list[bytes]:
        symbols = np.frombuffer("".join(sequences).encode("utf-16-le"), "<u2")
        if not len(symbols):
            return [b""] * len(sequences)
        sizes = np.fromiter(map(len, sequences), np.int32, len(sequences))
        ends = np.cumsum(sizes, dtype=np.int32)
        begins = ends - sizes
        last = self._last(symbols, np.repeat(begins, sizes), np.repeat(ends, sizes))
        # backwards from every end, a token at a time
        open_ = np.flatnonzero(sizes)
        at, steps = ends[open_] - 1, []
        while len(open_):
            token = last[at]
            steps.append((open_, token))
            at = at - self._sizes[token]
            more = at >= begins[open_]
            open_, at = open_[more], at[more]
        counts = np.bincount(np.concatenate([s for s, _ in steps]), minlength=len(sequences))
        stop = np.cumsum(counts)
        flat = np.zeros(int(stop[-1]), "<u4")
        for k, (own, token) in enumerate(steps):
            flat[stop[own] - 1 - k] = self._ids[token]
        data, bounds = flat.tobytes(), [0, *(4 * stop).tolist()]
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]

    def _last(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The last token (its number) of every prefix, by the prefix's last symbol."""
        starts = np.arange(len(symbols), dtype=np.int32)
        node, size, found = self._first[symbols], 1, []
        while len(starts):
            alive = np.flatnonzero(node >= 0)
            starts, node = starts[alive], node[alive]
            token = self._token_at[node]
            some = np.flatnonzero(token >= 0)
            found.append((starts[some], token[some], starts[some] + np.int32(size - 1)))
            inside = np.flatnonzero(starts + size < end[starts])
            starts = starts[inside]
            node = self._next.get(node[inside].astype(np.int64) << _SYMBOL_BITS | symbols[starts + size])
            size += 1
        start, token, stop = (np.concatenate(c) for c in zip(*found[::-1]))  # the longest first
        place = (stop - begin[stop]).astype(np.uint16)
        order = np.argsort(place, kind="stable")
        start, token, stop = start[order], token[order], stop[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(place))])
        whole = start == begin[start]
        last = np.full(len(symbols), -1, np.int32)
        for a, b in zip(bounds[:-1], bounds[1:]):
            first, some = whole[a:b], token[a:b]
            fits = first.copy()
            rest = np.flatnonzero(~first)
            fits[rest] = self._compatible(last[start[a:b][rest] - 1], some[rest])
            at = np.flatnonzero(fits)[::-1]  # of equal indices the last one stays: the longest
            last[stop[a:b][at]] = some[at]
        if (last < 0).any():
            raise ValueError("a symbol without a token")
        return last
