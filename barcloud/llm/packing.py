"""Packing token sequences by bounded-space online best fit.

Documents are tokenised and cut into pieces of at most ``CAPACITY`` tokens.  A full piece is a
sequence by itself; the others are dealt by a hash to packers of about ``PIECES_PER_PACKER`` pieces
each, so their number follows the data and none grows with it.  A packer keeps at most ``OPEN_BINS``
bins open, in stacks by free space with a bitset of the free sizes in use: the best fit is the lowest
set bit at or above the length, and when a new bin would be one too many the fullest closes.  Pieces come
in an order mixed by hash, in windows of as many pieces as bins may be open, longest first in each:
the bins stay few and the space left over is a few ten-thousandths.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcloud.llm.common import table, texts
from barcloud.llm.tokens import word_bpe
from barcloud.session import write_table

CAPACITY = 2048
OPEN_BINS = 2048
PIECES_PER_PACKER = 250_000
END_ID = 0

_PIECE = "piece int, start long, length long, ids_crc32 long"


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class Bins:
    """Open bins by free space; bins are numbered from 0 in the order they open."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0  # bit f is set if a bin with free space f is open
        self.open = self.opened = 0

    def put(self, length: int) -> tuple[int, int]:
        """The bin for a piece of 1 to ``capacity`` tokens and the piece's offset in it."""
        fits = self.used >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.used & -self.used).bit_length() - 1)  # the fullest closes
            number, free = self.opened, self.capacity
            self.opened += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.used |= 1 << left
            self.open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.used &= ~(1 << free)
        self.open -= 1
        return number


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    path: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked, the ``ids`` (little-endian unsigned 32 bit).

    Null text is empty and gives the end id alone; repeated rows give their pieces each.
    """
    path = path or vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            rows, ids_out = [], []
            for i, ids in enumerate(word_bpe(path).every(texts(batch, text_col))):
                ids = memoryview(ids + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(own) // 4, zlib.crc32(own)))
                    if with_ids:
                        ids_out.append(bytes(own))
            if not rows:
                continue
            at, *columns = np.array(rows, np.int64).T
            arrays = [batch.column(id_col).take(pa.array(at)), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids_out, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"`{id_col}` {kind}, {_PIECE}" + ", ids binary" * with_ids
    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def pack(
    cut: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
    pieces_per_packer: int = PIECES_PER_PACKER,
) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; lengths are 1 to ``capacity``, every piece stays.

    Other columns (such as ids) travel along; give smaller packers then, for a packer's pieces are held
    in memory.  Sequences are numbered by packer and bin, those of one full piece below zero.
    """
    partial = cut.where(F.col("length") < capacity)
    packers = max(1, math.ceil(partial.count() / pieces_per_packer))
    dealt = partial.withColumn("_packer", F.pmod(F.xxhash64(id_col, "piece"), F.lit(packers)))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema]
    schema = ", ".join([*fields, "sequence_id long", "offset long"])
    names = cut.columns

    def place(key, group):
        lengths, crc, start = (group.column(c).to_numpy() for c in ("length", "ids_crc32", "start"))
        order = np.lexsort([start, crc])
        window = np.arange(len(order)) // open_bins
        order = order[np.lexsort([-lengths[order], window])]
        group = group.select(names).take(pa.array(order))
        bins = Bins(capacity, open_bins)
        placed = np.array([bins.put(n) for n in group.column("length").to_pylist()], np.int64).reshape(-1, 2)
        base = key[0].as_py() << 32
        return group.append_column("sequence_id", pa.array(placed[:, 0] + base)).append_column("offset", pa.array(placed[:, 1]))

    packed = dealt.groupBy("_packer").applyInArrow(place, schema)
    whole = cut.where(F.col("length") >= capacity)
    alone = (-1 - F.monotonically_increasing_id()).alias("sequence_id")
    whole = whole.select(*names, alone, F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The packed pieces of ``docs`` by whole text; the cut pieces are written once, without texts."""
    return pack(write_table(pieces(docs, id_col, text_col), "packing-pieces"), id_col, **options)


def op3_packing_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
