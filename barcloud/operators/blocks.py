"""Read pairs in blocks: rows of a Parquet table that hold whole pairs as Arrow arrays, some ten thousand candidates each.

Candidates are shuffled and sorted once.  Steps run over the arrays of a block; what a step needs to know of other
blocks (facts of clouds and of their bins) travels as one row for each key of a block.  A block is as large as ``ROWS``, or as a read pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barcloud.config import SkewPolicy
from barcloud.operators.candidates import PAIR
from barcloud.session import limit_batches

#: candidates of a block
ROWS = 1 << 16
#: read pairs of a barcode that share a place in the shuffle, and the places a barcode has at least
PAIRS, PLACES = 1 << 14, 16
#: bytes of the blocks that reach Python at once
BATCH = 8 << 20
#: a number below all others, for null
NONE = -(1 << 62)

_BLOCKS = T.StructType([T.StructField("block", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("rest", T.BinaryType())])
_IPC = pa.ipc.IpcWriteOptions(compression="lz4")


def _dump(batch: pa.RecordBatch) -> pa.Buffer:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_IPC) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def load(value: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(value.as_buffer()).read_next_batch()


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    one, other = column.slice(1), column.slice(0, max(0, len(column) - 1))
    differ = pc.fill_null(pc.not_equal(one, other), False).to_numpy(zero_copy_only=False)
    return differ | (one.is_null().to_numpy(zero_copy_only=False) != other.is_null().to_numpy(zero_copy_only=False))


def numbers(column: pa.Array, null: int = NONE) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def reals(column: pa.Array) -> np.ndarray:
    """Null as NaN."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def flags(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, False).to_numpy(zero_copy_only=False)


def groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's group, first row of each group), groups in the order of ``columns``."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for column in columns:
        there = column[order]
        new[1:] |= there[1:] != there[:-1]
    new[:1] = True
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def pack(rows: DataFrame, working: list[str], tasks: int) -> DataFrame:
    """The table of blocks: (block, the ``working`` columns, the others)."""
    limit_batches(rows.sparkSession, BATCH)
    place = F.pmod(F.xxhash64("ident"), F.greatest(F.lit(PLACES), F.ceil(F.col("n_pairs") / PAIRS)))
    placed = rows.repartition(tasks, "bc", place).sortWithinPartitions(*PAIR, "gpos", "mate", "bwa_rank")
    return placed.mapInArrow(_packer(working, ROWS), _BLOCKS)


class Blocks:
    """Candidates packed by read pair, as :func:`pack` has them, written."""

    def __init__(self, table: DataFrame, schema: T.StructType, policy: SkewPolicy):
        self.table, self.schema, self.policy = table, schema, policy

    def run(self, step: Callable, schema: T.StructType, state: DataFrame | None = None, rest: bool = False) -> DataFrame:
        """The batches of ``step(block number, working columns, state or None, other columns)`` for each block."""
        names = ["block", "data", *(["rest"] if rest else [])]
        rows = self.table.select(*names)
        if state is not None:
            size = state.agg(F.sum("size")).first()[0] or 0
            told = state.select("block", F.struct(*[c for c in state.columns if c != "block"]).alias("state"))
            # beyond a bound the blocks, which are few, move
            rows = rows.join(F.broadcast(told) if size <= self.policy.max_broadcast_rows // 16 else told.hint("shuffle_hash"), "block", "left")
        arrow, stated = to_arrow_schema(schema), state is not None

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = lambda name, i: batch.column(name)[i]
                for i in range(len(batch)):
                    told = column("state", i) if stated and column("state", i).is_valid else None
                    found = step(column("block", i).as_py(), load(column("data", i)), told, load(column("rest", i)) if rest else None)
                    yield pa.RecordBatch.from_arrays([pa.array(found[f.name]).cast(f.type) for f in arrow], schema=arrow)

        return rows.mapInArrow(work, schema)

    def rows(self, step: Callable, added: list[T.StructField], state: DataFrame | None = None) -> DataFrame:
        """All candidates with what ``step(block number, working columns, state's row)`` tells of them."""
        names = {f.name for f in added}
        schema = T.StructType([*[f for f in self.schema if f.name not in names], *added])

        def whole(block, data, told, rest):
            held = {name: part.column(name) for part in (data, rest) for name in part.schema.names}
            return held | step(block, data, told)

        return self.run(whole, schema, state, rest=True)


def _packer(working: list[str], size: int) -> Callable:
    arrow = to_arrow_schema(_BLOCKS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, TaskContext.get().partitionId() << 32

        def cut(rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal number
            number += 1
            others = [c for c in rows.schema.names if c not in working]
            made = [pa.array([number], pa.int64()), *[pa.array([_dump(rows.select(c)).to_pybytes()], pa.binary()) for c in (working, others)]]
            return pa.RecordBatch.from_arrays(made, schema=arrow)

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= size:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                ends = np.flatnonzero(changes(rows.column("bc")) | changes(rows.column("ident"))) + 1
                end = int(ends[-1]) if len(ends) else 0  # the last pair may go on in the next batch
                if end:
                    yield cut(rows.slice(0, end))
                held, n = [rows.slice(end)], len(rows) - end
        if n:
            yield cut(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return pack


def shared(parts: DataFrame, keys: list[str], facts: dict[str, Column], more: DataFrame | None = None) -> DataFrame:
    """``parts`` with the facts of their keys: a row for each ``slot`` of a block; ``more`` has rows of the same keys that are in no block.

    A key has at most a row for each block it occurs in, and one of ``more``.
    """
    if more is not None:
        parts = parts.unionByName(more.withColumns({"block": F.lit(None).cast("long"), "slot": F.lit(None).cast("int")}), True)
    group = Window.partitionBy(*keys)
    return parts.withColumns({name: agg.over(group) for name, agg in facts.items()})


def listed(told: DataFrame, facts: dict[str, Column]) -> DataFrame:
    """(block, size, lists of facts by slot) of the rows of :func:`shared`."""
    every = F.array_sort(F.collect_list(F.struct("slot", *[c.alias(name) for name, c in facts.items()])))
    return told.where(F.col("block").isNotNull()).groupBy("block").agg(every.alias("_all")).select(
        "block", F.size("_all").alias("size"), *[F.col(f"_all.{name}").alias(name) for name in facts])
