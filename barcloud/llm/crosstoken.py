"""Two tokenizers aligned by bytes: groups between common token ends, and corpus-wide counts of id pairs.

Tokenizer A (byte-level BPE, ``byte_bpe_50k.json``) reads a space and the text, tokenizer B (``piece_bpe_32k.model``) adds that
space itself; both cut the same bytes.  Offsets where tokens of both end cut them into groups; a link is a pair
of tokens whose bytes overlap, so all links lie within groups.

An array gives for each A id the B id with the same bytes.  A group of one token each that the array pairs is
*exact*: such groups are counted by A id alone, in vectors of the vocabulary's length, and never leave a task as pairs.  Only
the links of other groups enter the shuffle of pairs, summed per block of documents before.

No token of either reaches from a character into following white space, or from a letter into a following full stop or comma,
so texts are cut there; each distinct stretch of a block of documents goes through both tokenizers once and all are
aligned together, as arrays.  Texts with other white space, controls or U+2581 are one stretch.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barcloud.llm.common import attach_facts, table, texts
from barcloud.llm.tokens import byte_letters
from barcloud.session import limit_batches, write_table

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A block of documents ends with the one that reaches so many characters.
BLOCK_CHARS = 1 << 21
#: An Arrow batch of blocks, of about 2 MB each: the JVM and Python hold a batch twice while it is made or taken apart.
BATCH_BYTES = 8 << 20
_AT_ONCE = 2048
_SPACE = "\u2581"
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_WHOLE = re.compile("[\x00-\x08\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u2581\u3000\ufeff]")
_STRETCH = re.compile(f"\n(?=[^ \t\n])|[ \t\n]*[^ \t\n.,]*[{_LETTER}](?=[.,])|[ \t\n]*[^ \t\n]+|[ \t\n]+")
_BYTE = re.compile("<0x([0-9A-F]{2})>")


class _Numbers(dict):
    """Numbers keys in the order they come."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class Aligner:
    """Both tokenizers and the bytes of their tokens; ``same`` has for each A id the B id with its bytes, or -1."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its own core
        self._a = Tokenizer.from_file(path_a)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {letter: byte for byte, letter in byte_letters().items()}
        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        bytes_a = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items() if all(c in letters for c in t)}
        self.size_a = self._a.get_vocab_size()
        self._bytes_a = [bytes_a.get(i, b"") for i in range(self.size_a)]
        pieces = [self._b.id_to_piece(i) for i in range(self._b.piece_size())]
        self._bytes_b = [self._piece_bytes(i, p) for i, p in enumerate(pieces)]
        self._sizes_a, self._sizes_b = (np.array([len(v) for v in x], np.int64) for x in (self._bytes_a, self._bytes_b))
        # pieces before byte stand-ins: where two ids have the same bytes, the piece is the usual one
        ids = {v: i for i, v in reversed(list(enumerate(self._bytes_b))) if v}
        ids |= {v: i for i, v in reversed(list(enumerate(self._bytes_b))) if v and not self._b.is_byte(i)}
        self.same = np.array([ids.get(v, -1) if v else -1 for v in self._bytes_a], np.int64)
        self._space = self._b.piece_to_id(_SPACE)
        # texts may only be cut where no piece reaches over
        self._cut = not any(re.search(f"[^{_SPACE}]{_SPACE}|[\t\n]|[{_LETTER}][.,]", p) for p in pieces)

    def _piece_bytes(self, number: int, piece: str) -> bytes:
        if self._b.is_control(number) or self._b.is_unknown(number):
            return b""
        if self._b.is_byte(number):
            return bytes([int(_BYTE.fullmatch(piece)[1], 16)])
        return piece.replace(_SPACE, " ").encode()

    def stretches(self, text: str | None) -> list[str]:
        """A space and the text, cut; nothing for a null or empty text."""
        if not text:
            return []
        text = " " + text
        return [text] if not self._cut or _WHOLE.search(text) else _STRETCH.findall(text)

    def _ids_a(self, stretches: list[str]) -> Iterator[list[int]]:
        """A's ids, some stretches at a time: what the library returns for each is much larger than its ids."""
        for at in range(0, len(stretches), _AT_ONCE):
            for found in self._a.encode_batch_fast(stretches[at : at + _AT_ONCE], add_special_tokens=False):
                yield found.ids

    def _ids_b(self, stretches: list[str]) -> list[list[int]]:
        """B's ids.  It adds a space before what it is given: that replaces a first space, and goes again from elsewhere."""
        given = [s[1:] if s[0] == " " else s if s[0] in "\t\n" else "\n" + s for s in stretches]
        found = self._b.encode(given, num_threads=1)
        drop = [0 if s[0] == " " else 1 if s[0] in "\t\n" else 2 for s in stretches]
        return [[self._space] if s == " " else f[d:] for s, f, d in zip(stretches, found, drop)]

    def align(self, stretches: list[str]) -> dict[str, object]:
        """All ``stretches`` aligned: per stretch tokens, groups, exact groups and other links, one behind the other.

        ``good`` marks those both tokenizers give back; the others have nothing.
        """
        n = len(stretches)
        raw = [s.encode() for s in stretches]
        ids = [list(self._ids_a(stretches)), self._ids_b(stretches)]
        given_back = [_given_back(raw, rows, names) for rows, names in zip(ids, (self._bytes_a, self._bytes_b))]
        good = given_back[0] & given_back[1]
        tokens, ends, counts = [], [], []
        for rows, sizes in zip(ids, (self._sizes_a, self._sizes_b)):
            rows = rows if good.all() else [row if g else [] for row, g in zip(rows, good)]
            counts.append(np.fromiter(map(len, rows), np.int64, n))
            tokens.append(np.fromiter(chain.from_iterable(rows), np.int64, int(counts[-1].sum())))
            ends.append(np.cumsum(sizes[tokens[-1]]))
        (a, b), (ends_a, ends_b) = tokens, ends
        limits = np.cumsum([len(r) if g else 0 for r, g in zip(raw, good)])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        stops_a, stops_b = np.searchsorted(ends_a, common) + 1, np.searchsorted(ends_b, common) + 1
        one = (np.diff(stops_a, prepend=0) == 1) & (np.diff(stops_b, prepend=0) == 1)
        exact = one & (self.same[a[stops_a - 1]] == b[stops_b - 1])
        # every piece between neighbouring ends of either lies in one token of each: that is their link
        cuts = np.union1d(ends_a, ends_b)
        other = ~exact[np.searchsorted(common, cuts)]
        of_stretch = np.searchsorted(limits, cuts)
        pairs = a[np.searchsorted(ends_a, cuts[other])] << 32 | b[np.searchsorted(ends_b, cuts[other])]
        group_stretch = np.searchsorted(limits, common)
        return {
            "good": good, "n_a": counts[0], "n_b": counts[1], "n_groups": np.bincount(group_stretch, minlength=n), "a": a, "b": b,
            "group_a": np.diff(stops_a, prepend=0), "group_b": np.diff(stops_b, prepend=0), "exact": a[stops_a[exact] - 1],
            "exact_sizes": np.bincount(group_stretch[exact], minlength=n), "pairs": pairs,
            "pair_sizes": np.bincount(of_stretch[other], minlength=n),
        }


def _given_back(raw: list[bytes], rows: list[list[int]], names: list[bytes]) -> np.ndarray:
    """Which stretches the bytes of their tokens give back."""
    joined = [b"".join([names[i] for i in row]) for row in rows]
    if joined == raw:
        return np.ones(len(raw), bool)
    return np.array([r == j for r, j in zip(raw, joined)], bool)


def _group_texts(a: list[int], b: list[int], stops_a: list[int], stops_b: list[int]) -> list[str]:
    a, b, out, i, j = list(map(str, a)), list(map(str, b)), [], 0, 0
    for x, y in zip(stops_a, stops_b):
        out.append(f"{a[i]}|{b[j]}" if x - i == y - j == 1 else ",".join(a[i:x]) + "|" + ",".join(b[j:y]))
        i, j = x, y
    return out


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The tokenizers of two files, loaded once per Python worker."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


class _Block:
    """Documents of a block as numbers of their distinct stretches."""

    def __init__(self, both: Aligner):
        self.both, self.ids, self.rows, self.numbers, self.chars = both, [], [], _Numbers(), 0

    def add(self, key, text: str | None, chars: int) -> None:
        self.ids.append(key)
        self.chars += chars
        self.rows.append(np.array(list(map(self.numbers.__getitem__, self.both.stretches(text))), np.uint32))

    def columns(self) -> dict[str, object]:
        """The block's row: documents as stretches, what the stretches hold, and the pairs of the block with their links."""
        made = self.both.align(list(self.numbers))
        size, good = len(self.numbers), made["good"]
        rows = self.rows if good.all() else [r if good[r].all() else r[:0] for r in self.rows]
        numbers = np.concatenate(rows).astype(np.int64)
        times = np.bincount(numbers, minlength=size)
        exact = np.bincount(made["exact"], np.repeat(times, made["exact_sizes"]), self.both.size_a).astype(np.int64)
        pairs, places = np.unique(made["pairs"], return_inverse=True)
        links = np.bincount(places, np.repeat(times, made["pair_sizes"]), len(pairs)).astype(np.int64)
        seen = np.flatnonzero(exact)
        packed = {c: _packed(made[c]) for c in _PACKED if c in made} | {"numbers": _packed(numbers), "places": _packed(places)}
        return {
            "ids": self.ids, "sizes": [len(r) for r in rows], "stretches": size, "exact_ids": seen, "exact_counts": exact[seen],
            "pairs": pairs, "pair_counts": links, **packed,
        }


def _packed(values: np.ndarray) -> bytes:
    """Numbers of 16 or 32 bits each, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u2" if values.max(initial=0) < 1 << 16 else "<u4").tobytes())


def _unpacked(value: pa.Scalar, length: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(value.as_py())
    return np.frombuffer(raw, "<u4" if length and len(raw) == 4 * length else "<u2").astype(np.int64)


#: Arrays of numbers of a block: stretches of the documents; of each stretch tokens, groups, exact groups and links; then
#: one behind the other tokens, tokens of each group, exact A ids, and places of the links in ``pairs``.
_PACKED = ["numbers", "n_a", "n_b", "n_groups", "exact_sizes", "pair_sizes", "a", "b", "group_a", "group_b", "exact", "places"]
_BLOCK = {
    "sizes": pa.list_(pa.int64()), "stretches": pa.int64(), "exact_ids": pa.list_(pa.int64()), "exact_counts": pa.list_(pa.int64()),
    "pairs": pa.list_(pa.int64()), "pair_counts": pa.list_(pa.int64()), **dict.fromkeys(_PACKED, pa.binary()),
}


def blocks(docs: DataFrame, id_col: str, text_col: str, path_a: str, path_b: str) -> DataFrame:
    """Aligned documents, a row per block of about ``BLOCK_CHARS`` characters; a longer text is a block of its own."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    spark_types = {pa.list_(pa.int64()): "array<long>", pa.binary(): "binary", pa.int64(): "long"}
    schema = f"block long, ids array<{kind}>, " + ", ".join(f"{c} {spark_types[t]}" for c, t in _BLOCK.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        number, block = TaskContext.get().partitionId() << 32, _Block(both)

        def out() -> pa.RecordBatch:
            made = block.columns()
            arrays = [pa.array([number], pa.int64()), pa.array([made["ids"]], pa.list_(id_type))]
            arrays += [pa.array([made[c]], t) for c, t in _BLOCK.items()]
            return pa.RecordBatch.from_arrays(arrays, ["block", "ids", *_BLOCK])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for key, text in zip(batch.column("id").to_pylist(), texts(batch, "text")):
                chars = 64 + len(text or "")
                if block.ids and block.chars + chars > BLOCK_CHARS:
                    yield out()
                    number, block = number + 1, _Block(both)
                block.add(key, text, chars)
        if block.ids:
            yield out()

    return rows.mapInArrow(run, schema)


def exact_counts(made: DataFrame, size_a: int) -> DataFrame:
    """Groups of one token each by A id: a vector of the vocabulary's length per task, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(size_a, np.int64)
        for batch in batches:
            ids, counts = batch.column("exact_ids"), batch.column("exact_counts")
            np.add.at(vector, ids.flatten().to_numpy(), counts.flatten().to_numpy())
        seen = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(vector[seen])], ["a", "n"])

    return made.select("exact_ids", "exact_counts").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def pair_counts(made: DataFrame, both: Aligner) -> DataFrame:
    """All linked id pairs: ``pair`` (A id * 2^32 + B id), links ``n``, whether that is the most of its B id, and blocks that ask for it."""
    per_block = made.select(F.explode(F.arrays_zip("pairs", "pair_counts")).alias("p"))
    irregular = per_block.select(F.col("p.pairs").alias("pair"), F.col("p.pair_counts").alias("n"), F.lit(1).alias("blocks"))
    same = made.sparkSession.createDataFrame(
        [(a, int(b)) for a, b in enumerate(both.same.tolist()) if b >= 0], "a long, b long"
    )  # at most the vocabulary
    exact = exact_counts(made, both.size_a).join(F.broadcast(same), "a")
    exact = exact.select(F.shiftleft("a", 32).bitwiseOR(F.col("b")).alias("pair"), "n", F.lit(0).alias("blocks"))
    pairs = irregular.unionByName(exact).groupBy("pair").agg(F.sum("n").alias("n"), F.sum("blocks").alias("blocks"))
    pairs = write_table(pairs, "token-pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = pairs.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # at most a row per B id
    return pairs.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"), "blocks")


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None
) -> DataFrame:
    """Per row of ``docs``: its id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and the ``groups`` as text.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``.  A link's count is how many links of all rows pair its ids; ``count_sum`` adds them and
    ``n_best`` counts links whose count no other A id reaches with the same B id.  Texts that are null, empty, or
    not given back by both tokenizers have zeros and ''.  Repeated rows count each; an empty table gives no row; other columns are not read.
    """
    path_a, path_b = path_a or public_tokenizers.path(A_FILE), path_b or public_tokenizers.path(B_FILE)
    limit_batches(docs.sparkSession, BATCH_BYTES)
    both = aligner(path_a, path_b)
    made = write_table(blocks(docs, id_col, text_col, path_a, path_b), "token-blocks")
    pairs = write_table(pair_counts(made, both), "token-pair-counts")
    # the exact pairs as two vectors of the vocabulary's length, which bounds them
    same = docs.sparkSession.createDataFrame([(a << 32 | int(b), a) for a, b in enumerate(both.same.tolist()) if b >= 0], "pair long, a long")
    known = pairs.join(F.broadcast(same), "pair").select("a", "n", "best").toPandas()
    count, best = np.zeros(both.size_a, np.int64), np.zeros(both.size_a, np.int64)
    count[known["a"]], best[known["a"]] = known["n"], known["best"]
    asked = made.select("block", F.explode("pairs").alias("pair"))
    answered = attach_facts(asked, pairs.where("blocks > 0"), ["pair"], "blocks", ["block"])
    facts = answered.groupBy("block").agg(F.collect_list(F.struct("pair", "n", "best")).alias("facts"))
    # a sorted join would hold the blocks of a task; the facts are the small side
    joined = made.select("block", "ids", "sizes", "stretches", "pairs", *_PACKED).join(facts.hint("shuffle_hash"), "block", "left")
    kind = made.schema["ids"].dataType.elementType.simpleString()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = f"`{id_col}` {kind}, {', '.join(f'{n} long' for n in names)}, groups string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, sums, groups = _finish({c: batch.column(c)[i] for c in batch.schema.names}, count, best)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, sums), pa.array(groups, pa.string())], [id_col, *names, "groups"])

    return joined.mapInArrow(run, schema)


def _summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``values``; of an empty one, zero."""
    ends = np.cumsum(sizes)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - sizes]


def _finish(row: dict[str, pa.Scalar], count: np.ndarray, best: np.ndarray) -> tuple[pa.Array, list[np.ndarray], list[str]]:
    size, sizes = row["stretches"].as_py(), row["sizes"].values.to_numpy()
    numbers = _unpacked(row["numbers"], int(sizes.sum()))
    n_a, n_b, n_groups, exact_sizes, pair_sizes = (
        _unpacked(row[c], size) for c in ("n_a", "n_b", "n_groups", "exact_sizes", "pair_sizes"))
    exact, places = _unpacked(row["exact"], int(exact_sizes.sum())), _unpacked(row["places"], int(pair_sizes.sum()))
    pairs = row["pairs"].values.to_numpy()
    n, most = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    if row["facts"].is_valid:
        facts = row["facts"].values
        at = np.searchsorted(pairs, facts.field("pair").to_numpy())
        n[at], most[at] = facts.field("n").to_numpy(), facts.field("best").to_numpy(zero_copy_only=False)
    of_stretch = [
        n_a, n_b, n_groups, exact_sizes + pair_sizes, _summed(best[exact], exact_sizes) + _summed(most[places], pair_sizes),
        _summed(count[exact], exact_sizes) + _summed(n[places], pair_sizes),
    ]
    sums = [_summed(np.asarray(v, np.int64)[numbers], sizes) for v in of_stretch]
    total = int(n_groups.sum())
    stops = [np.cumsum(_unpacked(row[c], total)).tolist() for c in ("group_a", "group_b")]
    every = _group_texts(_unpacked(row["a"], int(n_a.sum())).tolist(), _unpacked(row["b"], int(n_b.sum())).tolist(), *stops)
    ends = np.cumsum(n_groups)
    told = [";".join(every[e - k : e]) for k, e in zip(n_groups.tolist(), ends.tolist())]
    groups = [";".join([told[k] for k in numbers[e - s : e]]) for s, e in zip(sizes, np.cumsum(sizes))]
    return row["ids"].values, sums, groups


def op13_align_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document with the digest of its groups."""
    found = align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
