"""Token-id files compressed by Re-Pair grammars, with random access.

A file is one Parquet row per block of consecutive documents: the grammar and the symbols of all
their ids, and each document's place.  Re-Pair replaces the block's most frequent adjacent pairs by
nonterminals, round after round, until no pair is frequent enough.  A round takes many pairs at
once; where their occurrences overlap, every other one of the run is replaced, and a pair that is
then left with too few gets no rule.  Each rule keeps the length of its expansion, so a range of ids is
decoded from the symbols that cover it alone.

Block, all little-endian: magic ``RPG1``; unsigned 32-bit counts of rules, symbols and documents, the
width of a symbol in bytes (2 or 4) and the first nonterminal; rules as two 32-bit symbols each; the rules'
expansion lengths (32 bit); where each document begins (64 bit, one more than documents); the symbols.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barcloud.llm.common import table, texts
from barcloud.llm.tokens import word_bpe
from barcloud.session import shared_folder

END_ID = 2
#: A block ends with the document that reaches so many ids.
BLOCK_IDS = 1 << 18
ROUNDS = 6
#: A pair needs so many occurrences in the block to be worth a rule.
LEAST = 8
_HEADER = struct.Struct("<4s5I")
_MAGIC = b"RPG1"


def compress(ids: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS, least: int = LEAST) -> bytes:
    """A block of ``ids`` (unsigned 32 bit) with documents at ``starts``, whose last is the length."""
    first = int(ids.max()) + 1 if len(ids) else 0
    symbols, rules, lengths = ids.astype(np.uint32), [], np.zeros(0, np.int64)
    for _ in range(rounds):
        symbols, new = _replace(symbols, first + sum(map(len, rules)), least)
        if not len(new):
            break
        known = np.concatenate([np.ones(first, np.int64), lengths]) if rules else np.ones(first, np.int64)
        lengths = np.concatenate([lengths, known[new].sum(1)])
        rules.append(new)
    flat = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    width = 2 if first + len(flat) <= 1 << 16 else 4
    return b"".join([
        _HEADER.pack(_MAGIC, len(flat), len(symbols), len(starts) - 1, width, first),
        flat.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), starts.astype("<i8").tobytes(),
        symbols.astype(f"<u{width}").tobytes(),
    ])


_SLOT_BITS = 18


def _slots(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _replace(symbols: np.ndarray, number: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """``symbols`` with frequent pairs replaced by nonterminals from ``number`` on, and those pairs."""
    none = np.zeros((0, 2), np.uint32)
    if len(symbols) < 2 * least:
        return symbols, none
    pairs = symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:]
    # most pairs are rare: one whose hash is rare is left out before the sort
    slot = _slots(pairs)
    often = np.flatnonzero((np.bincount(slot, minlength=1 << _SLOT_BITS) >= least)[slot])
    pairs, slot = pairs[often], slot[often]
    held = np.sort(pairs)
    edges = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1], [True]])) if len(held) else np.zeros(1, np.int64)
    values = held[edges[:-1]][np.diff(edges) >= least]
    if not len(values):
        return symbols, none
    # a place's pair by a table over hashes; where two frequent pairs share a hash, by search
    at = _slots(values)
    table_ = np.zeros(1 << _SLOT_BITS, np.int32)
    table_[at] = np.arange(len(values))
    which = table_[slot]
    chosen = values[which] == pairs
    shared = np.bincount(at, minlength=1 << _SLOT_BITS) > 1
    if shared.any():
        other = np.flatnonzero(shared[slot] & ~chosen)
        found = np.minimum(np.searchsorted(values, pairs[other]), len(values) - 1)
        which[other], chosen[other] = found, values[found] == pairs[other]
    which, places = which[chosen], often[chosen]
    # of overlapping occurrences (a run of neighbouring places) every other one
    index = np.arange(len(places))
    begins = np.concatenate([[True], places[1:] != places[:-1] + 1])
    even = np.flatnonzero((index - np.maximum.accumulate(np.where(begins, index, 0))) & 1 == 0)
    places, which = places[even], which[even]
    left = np.bincount(which, minlength=len(values))
    kept = left >= least
    places, which = places[kept[which]], which[kept[which]]
    new = np.cumsum(kept) - 1 + number
    out = symbols.copy()
    out[places] = new[which]
    hold = np.ones(len(symbols), bool)
    hold[places + 1] = False
    rules = values[kept]
    return out[hold], np.stack([rules >> np.uint64(32), rules & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)


class Block:
    """Random access to a compressed block."""

    def __init__(self, blob: bytes):
        magic, n_rules, n_symbols, n_docs, width, self.first = _HEADER.unpack_from(blob)
        if magic != _MAGIC:
            raise ValueError("not a block of token ids")
        at = _HEADER.size
        self.rules = np.frombuffer(blob, "<u4", 2 * n_rules, at).reshape(-1, 2)
        self.lengths = np.frombuffer(blob, "<u4", n_rules, at := at + 8 * n_rules)
        self.starts = np.frombuffer(blob, "<i8", n_docs + 1, at := at + 4 * n_rules)
        self.symbols = np.frombuffer(blob, f"<u{width}", n_symbols, at + 8 * (n_docs + 1)).astype(np.uint32)
        self.ends = np.cumsum(np.concatenate([np.ones(self.first, np.int64), self.lengths])[self.symbols])
        self._bodies: np.ndarray | None = None

    def _expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """The expansions of all rules one behind the other, and where each begins."""
        if self._bodies is None:
            part = self.rules.ravel()
            while (inner := part >= self.first).any():
                out = np.zeros(len(part) + int(inner.sum()), np.uint32)
                at = np.arange(len(part)) + np.concatenate([[0], np.cumsum(inner)[:-1]])
                out[at[~inner]] = part[~inner]
                pairs = self.rules[part[inner] - self.first]
                out[at[inner]], out[at[inner] + 1] = pairs[:, 0], pairs[:, 1]
                part = out
            self._bodies = part
            self._begins = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        return self._bodies, self._begins

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``: only the symbols over that range are expanded."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left") + 1
        begin = int(self.ends[a - 1]) if a else 0
        part = self.symbols[a:b]
        inner = np.flatnonzero(part >= self.first)
        ends = self.ends[a:b] - begin
        sizes = np.diff(ends, prepend=0)
        out = np.repeat(part, sizes)
        if len(inner):
            bodies, begins = self._expanded()
            size = sizes[inner]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(ends[inner] - size, size) + within] = bodies[np.repeat(begins[part[inner] - self.first], size) + within]
        return out[start - begin : stop - begin]

    def document(self, number: int) -> np.ndarray:
        return self.ids(int(self.starts[number]), int(self.starts[number + 1]))


def write(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
    end_id: int = END_ID, block_ids: int = BLOCK_IDS,
) -> None:
    """Writes the ids of ``docs``, in ascending order of id, as blocks under ``folder``.

    Null text is empty (the end id alone), rows with a null id come first and repeated ids stay, in
    an order by text.  An empty table writes no block.  A shard is one range of ids, its blocks are numbered.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    tie = F.xxhash64(text_col)
    rows = docs.select(id_col, text_col).repartitionByRange(F.col(id_col), tie).sortWithinPartitions(F.col(id_col), tie)
    schema = f"shard int, block int, doc_ids array<{kind}>, n_docs long, n_tokens long, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, keys, held, size = TaskContext.get().partitionId(), 0, [], [], 0
        end = end_id.to_bytes(4, "little")

        def out() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(h) // 4 for h in held])])
            blob = compress(np.frombuffer(b"".join(held), "<u4"), starts)
            names = pa.array([keys], pa.list_(keys_type))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), names, pa.array([len(held)]),
                 pa.array([size]), pa.array([blob], pa.binary())],
                ["shard", "block", "doc_ids", "n_docs", "n_tokens", "ids"],
            )

        for batch in batches:
            keys_type = batch.schema.field(id_col).type
            for key, ids in zip(batch.column(id_col).to_pylist(), word_bpe(path).every(texts(batch, text_col))):
                ids += end
                keys.append(key)
                held.append(ids)
                size += len(ids) // 4
                if size >= block_ids:
                    yield out()
                    block, keys, held, size = block + 1, [], [], 0
        if held:
            yield out()

    rows.mapInArrow(encode, schema).write.parquet(folder)


def read(spark: SparkSession, folder: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of the files: id, start (ids before it in all files), n_tokens, ids_crc32 and, if asked, ids."""
    blocks = spark.read.parquet(folder)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one number per shard: as many as range partitions, not as documents
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    places = blocks.select("shard", "block", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("at"))
    places = places.join(F.broadcast(shards), "shard").select("shard", "block", (F.col("at") + F.col("shard_start")).alias("base"))
    placed = blocks.select("shard", "block", "doc_ids", "ids").join(places, ["shard", "block"])
    schema = f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                block = Block(batch.column("ids")[i].as_py())
                base = batch.column("base")[i].as_py()
                every = block.ids(0, int(block.starts[-1])).astype("<u4")
                own = [every[a:b].tobytes() for a, b in zip(block.starts[:-1], block.starts[1:])]
                arrays = [
                    batch.column("doc_ids")[i].values, pa.array(block.starts[:-1] + base), pa.array(np.diff(block.starts)),
                    pa.array([zlib.crc32(x) for x in own], pa.int64()),
                ]
                names = [id_col, "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(own, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return placed.mapInArrow(decode, schema)


def op7_ids_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), folder)
    return read(spark, folder)
