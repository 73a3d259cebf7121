"""Ids of the public tokenizer files, computed once per distinct word and joined per text.

A :class:`WordBPE` gives exactly the ids of the tokenizers library for ``word_bpe_49k.json``: white
space separates words there and every word is merged by itself, so a text's ids are the concatenation
of the ids of its white-space separated chunks, and most chunks have been seen before.  A chunk of
characters below U+0180 is lower-cased and split here (a whole text of them at once) and only unseen words go through the
model; any other chunk goes through the whole library.  Special-token strings in a text are ordinary text.
"""

from __future__ import annotations

import re
import weakref
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain
from sys import getsizeof

import numpy as np
from tokenizers import Tokenizer

#: Bytes all memories of a Python worker may hold together, whatever operators it has served.
BUDGET = 160 << 20
#: What a dictionary's entry costs beside its key and value, as the dictionary is filled and grows.
_ENTRY = 100
#: What a text and bytes cost together beside their characters (of up to two bytes each).
_OBJECTS = 110
#: Characters of the texts whose words are looked up together.
_AT_ONCE = 1 << 19


def together(texts: Iterable[str | None], chars: int = _AT_ONCE) -> Iterator[list[str | None]]:
    """Lists of neighbouring texts; a list ends with the text that reaches ``chars`` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


class Memory(dict):
    """Values by key, filled by ``make(key)``.

    A memory that has filled half its share of the budget, or holds ``limit`` keys, becomes the old generation, from which keys in use come back, and the
    generation before it goes: frequent keys stay known.  If all memories together pass ``BUDGET``, those that were last
    asked for a new key longest ago are emptied; they belong to a stage that is over, for workers are reused.
    """

    _every: dict[int, weakref.ref] = {}  # the least recently used one first
    _together = 0

    def __init__(self, make, limit: int | None = None, share: float = 0.25):
        super().__init__()
        self._make, self._limit, self._share = make, limit, share
        self._old, self._bytes, self._old_bytes = {}, 0, 0
        Memory._every[id(self)] = weakref.ref(self)

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if len(key) <= 64:  # a long key is rare and would fill the memory
            size = _ENTRY + getsizeof(key) + getsizeof(value)
            if 2 * (self._bytes + size) > self._share * BUDGET or len(self) == self._limit:
                self._turn()
            self[key] = value
            self._bytes += size
            Memory._together += size
            Memory._every[id(self)] = Memory._every.pop(id(self), None) or weakref.ref(self)
            if Memory._together > BUDGET:
                self._make_room()
        return value

    def learn(self, keys: set, make: Callable[[list], Iterable[bytes]]) -> None:
        """Holds ``keys`` (texts), as far as there is room; ``make`` gives the values (bytes) of the unknown ones together, in its order."""
        new = list(keys.difference(self))
        old = {k: self._old[k] for k in new if k in self._old}
        if old:
            new = [k for k in new if k not in old]
        old.update(zip(new, make(new)))
        keys = [k for k in old if len(k) <= 64]
        for at in range(0, len(keys), 1024):
            part = {k: old[k] for k in keys[at : at + 1024]}
            size = (_ENTRY + _OBJECTS) * len(part) + 2 * sum(map(len, part)) + sum(map(len, part.values()))
            if 2 * (self._bytes + size) > self._share * BUDGET:
                self._turn()
            self.update(part)
            self._bytes += size
            Memory._together += size
        if keys:
            Memory._every[id(self)] = Memory._every.pop(id(self), None) or weakref.ref(self)
        if Memory._together > BUDGET:
            self._make_room()

    def every(self, keys: list, make: Callable[[list], Iterable[bytes]]) -> list[bytes]:
        """The values of ``keys`` (texts, repeats included), looked up once; the unknown ones are learned together."""
        found = list(map(self.get, keys))
        if None in found:
            unknown = [i for i, value in enumerate(found) if value is None]
            self.learn({keys[i] for i in unknown}, make)
            for i in unknown:
                found[i] = self[keys[i]]
        return found

    def _turn(self) -> None:
        Memory._together -= self._old_bytes
        self._old, self._old_bytes, self._bytes = dict(self), self._bytes, 0
        self.clear()

    def empty(self) -> None:
        Memory._together -= self._bytes + self._old_bytes
        self._old, self._bytes, self._old_bytes = {}, 0, 0
        self.clear()

    def _make_room(self) -> None:
        for key, other in list(Memory._every.items()):
            if Memory._together <= BUDGET:
                return
            held = other()
            if held is None:
                del Memory._every[key]
            elif held is not self:
                held.empty()

    def __del__(self):
        Memory._together -= self._bytes + self._old_bytes
        Memory._every.pop(id(self), None)


# letters and numbers below U+0180; U+0130 lower-cases to two characters and is left to the library
_LETTERS = "a-zªµºß-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
PLAIN_LETTERS, PLAIN_NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ſ", _NUMBERS
PLAIN = re.compile("[\x00-\x1b\x20-įı-ſ]*")
#: ``str.split`` takes these for white space, the tokenizer doesn't.
_CONTROL = re.compile("[\x1c-\x1f]")
_WORDS = re.compile(
    f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+"
)

def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 stands for itself."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    others = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + i) for i, b in enumerate(others)}


class WordBPE:
    """``bytes_of(text)``, and ``every`` for many texts: the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = True
        self._model = self._library.model
        self._letters = byte_letters()
        self._words = Memory(self._word, share=0.5)
        self._chunks = Memory(self._chunk)

    def bytes_of(self, text: str | None) -> bytes:
        return next(self.every([text]))

    def every(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """``bytes_of`` each text; words that are new in many texts are made together."""
        chunk = self._chunks.__getitem__
        for some in together(texts):
            plain = [bool(text) and PLAIN.fullmatch(text) is not None for text in some]
            words = [_WORDS.findall(text.lower()) if whole else () for text, whole in zip(some, plain)]
            found, at = self._words.every(list(chain.from_iterable(words)), self._new_words), 0
            for text, whole, own in zip(some, plain, words):
                if whole:
                    yield b"".join(found[at : at + len(own)])
                    at += len(own)
                elif not text:
                    yield b""
                else:
                    yield self._whole(text) if _CONTROL.search(text) else b"".join(map(chunk, text.split()))

    def _chunk(self, chunk: str) -> bytes:
        if not PLAIN.fullmatch(chunk):
            return self._whole(chunk)
        return b"".join(map(self._words.__getitem__, _WORDS.findall(chunk.lower())))

    def _whole(self, text: str) -> bytes:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return self._new_words([word])[0]

    def _new_words(self, words: list[str]) -> list[bytes]:
        tokenize, letter = self._model.tokenize, self._letters.__getitem__
        spelled = [w if w.isascii() and w.isalnum() else "".join(map(letter, w.encode("utf-8"))) for w in words]
        rows = [[t.id for t in tokenize(w)] for w in spelled]
        ids = np.fromiter(chain.from_iterable(rows), "<u4").tobytes()
        ends = list(accumulate([4 * len(row) for row in rows]))
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


_loaded: dict[str, WordBPE] = {}


def word_bpe(path: str) -> WordBPE:
    """The tokenizer of ``path``, loaded once per Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]
