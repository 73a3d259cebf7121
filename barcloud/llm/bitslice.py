"""Exact top-k inner products over a bit-sliced index.

Components become integers ``floor(256 * x)``.  A block of rows keeps, per dimension, one bitmap for each
of the ``SLICES`` highest bits of the component's distance from the block's least one.  A query adds these
slices, weighted by the ``WEIGHT_BITS`` highest bits of its own components, with carry-save adders on
whole bitmaps (a negative weight adds complements).  The sums are lower bounds up to a known error, again as
slices: the k-th largest is read from the most significant slice downward, every row that could reach it
within the error is taken in the same way, and these boundary rows are resolved in exact integers.  A cell works in 64
bits where a bound on its largest components proves that they suffice, and in integers of any length otherwise.

Blocks and chunks of queries have a bounded number of rows; each pair of them is a cell, and a cell
returns a query's best few only.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barcloud.llm.common import small_or_shuffled, table

SLICES = 6
WEIGHT_BITS = 12
BLOCK_ROWS = 1 << 15
CHUNK_QUERIES = 256
#: Sums below this many, with their error bounds, fit 64 bits.
NARROW = 1 << 60
#: Doubles of this size or more are integers.
_WHOLE = 1 << 53


@dataclass(frozen=True)
class Index:
    """Bit slices of a block: ``slices[d, i]`` has bit ``drop + i`` of dimension d's distance from ``least``."""

    rows: np.ndarray
    least: np.ndarray
    most: np.ndarray
    drop: int
    slices: np.ndarray
    all_rows: np.ndarray


def index(rows: np.ndarray) -> Index:
    """``rows`` are integers (64 bits, or Python's in an object array), one row per vector; at least one row and one dimension."""
    least = rows.min(0)
    above = rows - least
    bits = int(above.max()).bit_length()
    drop = max(0, bits - SLICES)
    pad = -len(rows) % 64

    def bitmaps(flags: np.ndarray) -> np.ndarray:
        padded = np.pad(flags.astype(np.uint8), ((0, 0), (0, pad)))
        return np.ascontiguousarray(np.packbits(padded, axis=1, bitorder="little")).view("<u8")

    packed = np.stack([bitmaps(above.T >> bit & 1) for bit in range(drop, max(bits, drop + 1))], 1)
    everyone = bitmaps(np.ones((1, len(rows))))[0]
    return Index(rows, least, above.max(0), drop, packed, everyone)


def add_slices(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Slices of the sum, least significant first, of bitmaps stacked by weight ``2 ** column``."""
    out, column, last = [], 0, max(columns, default=-1)
    while column <= last:
        stacks = columns.pop(column, [])
        stack = np.concatenate(stacks) if stacks else np.zeros((0, 0), "<u8")
        while len(stack) > 1:
            third = len(stack) // 3
            if third:  # full adders: three bitmaps become one here and one in the next column
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                half = a ^ b
                carry = (a & b) | (half & c)
                stack = np.concatenate([half ^ c, stack[3 * third :]])
            else:
                carry = stack[:1] & stack[1:]
                stack = stack[:1] ^ stack[1:]
            columns.setdefault(column + 1, []).append(carry)
            last = max(last, column + 1)
        out.append(stack[0] if len(stack) else None)
        column += 1
    return out


def kth_largest(sums: list[np.ndarray], everyone: np.ndarray, k: int) -> int:
    """The k-th largest sum (of at least k rows), bit by bit from the most significant slice."""
    equal, wanted, value = everyone, k, 0
    for bit in range(len(sums) - 1, -1, -1):
        ones = equal & sums[bit]
        n = int(np.bitwise_count(ones).sum())
        if n >= wanted:
            equal, value = ones, value | 1 << bit
        else:
            equal, wanted = equal & ~sums[bit], wanted - n
    return value


def at_least(sums: list[np.ndarray], everyone: np.ndarray, value: int) -> np.ndarray:
    """Rows whose sum is ``value`` or more, as a bitmap."""
    if value <= 0:
        return everyone
    above, equal = np.zeros_like(everyone), everyone
    for bit in range(len(sums) - 1, -1, -1):
        if value >> bit & 1:
            equal = equal & sums[bit]
        else:
            above, equal = above | (equal & sums[bit]), equal & ~sums[bit]
    return above | equal


def candidates(own: Index, query: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the rows that can be among the k of largest inner product; ties are all there."""
    n = len(own.rows)
    if n <= k:
        return np.arange(n)
    size = np.abs(query)
    shift = max(0, int(size.max()).bit_length() - WEIGHT_BITS)
    weight = size >> shift
    depth = own.slices.shape[1]
    full = (((1 << depth) - 1) << own.drop) + (1 << own.drop) - 1
    columns: dict[int, list[np.ndarray]] = {}
    for sign in (False, True):
        for bit in range(WEIGHT_BITS):
            dims = np.flatnonzero((weight >> bit & 1).astype(bool) & ((query < 0) == sign))
            if len(dims):
                for i in range(depth):
                    slices = own.slices[dims, i]
                    columns.setdefault(bit + i, []).append(~slices & own.all_rows if sign else slices)
    if not columns:
        return np.arange(n)
    sums = [s if s is not None else np.zeros_like(own.all_rows) for s in add_slices(columns)]
    # what the dropped bits of the query and of the rows can add to a row's sum, in units of the sums
    most = np.where(query < 0, full, own.most)
    error = int(((size - (weight << shift)) * most).sum() + (weight << shift).sum() * ((1 << own.drop) - 1))
    unit = 1 << (shift + own.drop)
    floor_ = kth_largest(sums, own.all_rows, k) - -(-error // unit)
    return np.flatnonzero(np.unpackbits(at_least(sums, own.all_rows, floor_).view(np.uint8), count=n, bitorder="little"))


def best(own: Index, ids: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k highest, ties to the smaller id."""
    at = candidates(own, query, k)
    scores = own.rows[at] @ query
    order = sorted(range(len(at)), key=lambda i: (-scores[i], ids[at[i]])) if scores.dtype == object else np.lexsort([ids[at], -scores])
    return ids[at][order[:k]], scores[order[:k]]


def integers(block: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices of whole doubles as 64-bit integers if no sum of ``candidates`` or ``best`` can pass ``NARROW``, else as Python's."""
    most = [int(np.abs(m).max()) for m in (block, queries)]
    narrow = 8 * block.shape[1] * (most[0] + 1) * (most[1] + 1) < NARROW
    exact = lambda m: m.astype(np.int64) if narrow else np.vectorize(int, otypes=[object])(m)
    return exact(block), exact(queries)


def quantised(vector: Column) -> Column:
    """Whole doubles of a usable vector; null where 256 times a component is null or not finite, or the vector is null or empty."""
    scaled = F.transform(vector, lambda x: x.cast("double") * 256)
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < _WHOLE, F.floor(x).cast("double")).otherwise(x))
    return F.when(finite & (F.size(vector) > 0), whole)


def top(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """The ``k`` highest inner products of each row for which ``is_query`` holds: query_id, rank, vec_id, score.

    Candidates are the rows of the query's dimension with another id; all of them if fewer.  Rows without
    an id or whose vector is null, empty or has a component that is null or not finite (256 times it, in double
    precision) take no part; equal rows count once; an empty table gives no row.  Scores are exact decimals; one of more than 38
    digits is an error.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("q"), is_query.alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & F.col("q").isNotNull()).withColumn("dim", F.size("q"))
    once = rows.groupBy("id", "dim", "q").agg(F.max("asked").alias("asked"))
    asked = once.where("asked").drop("asked")

    def cut(df: DataFrame, most: int, name: str) -> DataFrame:
        return df.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias(name))

    sizes = small_or_shuffled(cut(once, BLOCK_ROWS, "blocks").join(cut(asked, CHUNK_QUERIES, "chunks"), "dim"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = once.join(sizes, "dim").select("dim", "id", "q", own("blocks").alias("block"), numbers("chunks").alias("chunk"))
    right = asked.join(sizes, "dim").select("dim", "id", "q", own("chunks").alias("chunk"), numbers("blocks").alias("block"))
    right = right.toDF("of_dim", "query_id", "weights", "of_chunk", "of_block")
    key = ["dim", "block", "chunk"]

    def cell(key, block, queries):
        found = [(np.zeros(0, np.int64),) * 3]
        if len(block) and len(queries):
            matrix = lambda t, name: t.column(name).combine_chunks().flatten().to_numpy().reshape(len(t), -1)
            rows, weights = integers(matrix(block, "q"), matrix(queries, "weights"))
            ids, indexed = block.column("id").to_numpy(), index(rows)
            for query, q in zip(queries.column("query_id").to_numpy(), weights):
                near, scores = best(indexed, ids, q, k + 1)
                other = near != query
                found.append((np.full(other.sum(), query), near[other], scores[other]))
        of, near, scores = map(np.concatenate, zip(*found))
        decimals = pa.array([Decimal(int(v)) for v in scores], pa.decimal128(38, 0))
        return pa.table({"query_id": of, "vec_id": near, "score": decimals})

    cells = left.groupBy(*key).cogroup(right.groupBy("of_dim", "of_block", "of_chunk")).applyInArrow(cell, "query_id long, vec_id long, score decimal(38,0)")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return cells.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk_bitslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).withColumn("score", F.col("score").cast("long"))


OP4_SQL = """
WITH rows AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)]) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5
"""
