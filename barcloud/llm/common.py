"""Helpers the operators share: table access, Arrow-batch columns, column names, heavy keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barcloud.operators.skew import attach_by_key

#: Facts of at most this many keys are broadcast (narrow rows: a key and a few numbers each).
MAX_BROADCAST_ROWS = 1_000_000
#: A key is heavy from this share of all rows on, so there are at most 1/HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1 / 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns a result is about to add, in any spelling Spark takes for the same name."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``_name``, ``__name`` and so on that is no column of ``df`` in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_arrow_columns(
    df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, pa.Array]], new: T.StructType, drop: tuple[str, ...] = ()
) -> DataFrame:
    """``df`` plus the columns ``make`` computes for each Arrow batch; columns in ``drop`` are its inputs only."""
    kept = [f for f in without(df, *new.names, *drop).schema]
    schema = T.StructType([*kept, *new])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch)
            arrays = [batch.column(f.name) if f.name not in made else made[f.name] for f in schema]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str) -> Iterator[str | None]:
    """The texts of a batch one by one, so that no second copy of the batch is held."""
    return (v.as_py() for v in batch.column(column))


def bytes_and_offsets(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array, concatenated, and where each row's begin; null rows are empty."""
    if array.null_count:
        array = array.fill_null(b"")
    _, offsets, values = array.buffers()
    offsets = np.frombuffer(offsets, "<i4")[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def attach_facts(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, spread_on: list[str]) -> DataFrame:
    """Left join with one-row-per-key ``facts``, whose ``count`` has the key's rows; heavy keys are dealt over all tasks."""
    total = facts.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) > F.lit(max(1000.0, total * HEAVY_SHARE))
    return attach_by_key(rows, facts, keys, heavy, spread_on)


def small_or_shuffled(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count proves it small; a shuffle join otherwise."""
    return F.broadcast(df) if df.count() <= rows else df


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
