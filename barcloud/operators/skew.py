"""Joining per-key facts back to rows when a key may hold a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barcloud.config import SkewPolicy

_SALT = "_salt"
#: How many barcodes of a broadcast take the room of one row of facts.
_WIDE = 16


def attach_by_key(
    rows: DataFrame, facts: DataFrame, keys: list[str], heavy: Column, spread_on: list[str]
) -> DataFrame:
    """Left join ``rows`` with one-row-per-key ``facts`` without a hot task, in one pass over ``rows``.

    ``heavy`` marks the facts of heavy keys (row count above ``SkewPolicy.threshold``): there are
    at most ``max_heavy_keys`` of them, so they are broadcast.  The rows they answer, and rows
    without a key, get a salt from ``spread_on`` and so a join key that no fact has: they are dealt
    over all join tasks.  Every other key is light and joined by hash with salt 0.  The zero of the
    facts is computed from the key, because a literal would be folded into a filter and leave
    the key alone in the exchange.  Rows and results stay whole.
    """
    values = [c for c in facts.columns if c not in keys]
    hot = facts.where(heavy).select(*keys, F.struct(*values).alias("_hot"))
    zero = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")
    cold = facts.where(~heavy).select(*keys, F.struct(*values).alias("_cold"), zero.alias(_SALT))
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    spread = F.lit(1) + F.pmod(F.xxhash64(*spread_on), F.lit(1 << 20)).cast("int")
    joined = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn(_SALT, F.when(F.col("_hot").isNull() & ~missing, zero).otherwise(spread))
        .join(cold, [*keys, _SALT], "left")
    )
    fact = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[fact[v].alias(v) for v in values])


def attach_small(rows: DataFrame, facts: DataFrame, keys: list[str], heavy: Column, spread_on: list[str], policy: SkewPolicy) -> DataFrame:
    """:func:`attach_by_key` that leaves ``rows`` where they are when ``facts``, a written table, is proven small."""
    if facts.count() > policy.max_broadcast_rows // _WIDE:
        return attach_by_key(rows, facts, keys, heavy, spread_on)
    values = [c for c in facts.columns if c not in keys]
    return rows.join(F.broadcast(facts), keys, "left").select(*rows.columns, *values)


#: Bytes of the driver's heap that a row of a broadcast takes while its table is built, and the share of the heap one may have.
_ROW_BYTES, _SHARE = 100, 0.25


def broadcast_limit(policy: SkewPolicy, heap: int) -> int:
    """Rows of a broadcast: as the policy says, and no more than a driver of ``heap`` bytes can build beside others."""
    return min(policy.max_broadcast_rows, int(heap * _SHARE / _ROW_BYTES))


def fits_broadcast(df: DataFrame, policy: SkewPolicy) -> bool:
    """Proves the size bound by a count: one number per task is shuffled."""
    heap = df.sparkSession.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()
    return df.count() <= broadcast_limit(policy, heap)


def bounded_dim(df: DataFrame, policy: SkewPolicy) -> DataFrame:
    """``df`` marked for broadcast when its size is proven small, else left to a shuffle join."""
    return F.broadcast(df) if fits_broadcast(df, policy) else df
