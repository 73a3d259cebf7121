"""Expectation-maximisation over candidate alignments and molecule clouds.

Rewrites used (all exact):

* Dividing cloud weights by a per-component or per-read constant cancels in the softmax, so cloud
  components are not built.
* Within a round cloud weights are fixed and a read only looks at its own mate, so a sequential
  sweep equals two half-steps: first the mate that was inserted later (the leader), then the other.
* The mate term max(penalty + ln gamma, -15) with penalty 0 inside the insert window and -15
  outside equals max(-15, ln of the largest partner gamma inside the window): a range window, no
  pairs of candidates are emitted.  Two positions in the window are always in the same cloud,
  because dist_thresh is at least the window.
* exp(score + ln weight + mate term) is the plain product
  exp(score) * weight * max(e^-15, partner gamma).  The normaliser is constant per read, so the
  partner maximum is taken over products and divided afterwards: one window pass per half-step
  yields both the normaliser of the moved mate and the partner maximum for the other one.

Everything per read pair uses one sort order (bc, ident, gpos); only the cloud facts change it.
"""

from __future__ import annotations

import math
from contextlib import ExitStack

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barcloud.config import (
    EM_MIN_PAIRS, EM_ROUNDS, GAMMA_FLOOR, GENOME_STRIDE, UNPAIRED_PENALTY,
)
from barcloud.operators.blocks import listed, shared
from barcloud.operators.candidates import CANDIDATE
from barcloud.operators.clouds import CLOUD
from barcloud.operators.skew import attach_by_key
from barcloud.operators.sweep import Sweep

_TINY = 1e-200  # keeps clouds without any active support finite
_NO_MATE = math.exp(UNPAIRED_PENALTY)


def _own(prefix: str) -> Column:
    """Pick the pair fact of the row's own mate from columns <prefix>0 and <prefix>1."""
    return F.when(F.col("mate") == 0, F.col(f"{prefix}0")).otherwise(F.col(f"{prefix}1"))


def _per_mate(prefix: str, agg, value: Column) -> dict[str, Column]:
    return {f"{prefix}{m}": agg(F.when(F.col("mate") == m, value)) for m in (0, 1)}


def _floored(term: Column, largest: Column) -> Column:
    """Terms below 1e-50 / n of the largest vanish."""
    return F.when(term < largest * F.lit(GAMMA_FLOOR) / F.col("n_cands"), F.lit(0.0)).otherwise(term)


def initialise(layout, df: DataFrame) -> DataFrame:
    """Add gamma from alignment scores alone.

    Also: n_cands of the read, its likelihood relative to the read's best, and ``repeats`` (the
    read occurred in this cloud before, in position order).
    """
    gcloud = F.col("chrom").cast("long") * F.lit(GENOME_STRIDE) + F.col("cloud")
    df = layout.repeats(df.withColumn("gcloud", gcloud))
    facts = {**_per_mate("_n", F.count, F.lit(1)), **_per_mate("_top", F.max, F.col("score"))}
    df = layout.pair_pass(df, facts).withColumns({
        "n_cands": _own("_n"), "likelihood": F.exp(F.col("score") - _own("_top"))}).drop(*facts)
    df = df.withColumn("gamma", _floored(F.col("likelihood"), F.lit(1.0)))
    sums = _per_mate("_sum", F.sum, F.col("gamma"))
    return layout.pair_pass(df, sums).withColumn("gamma", F.col("gamma") / _own("_sum")).drop(*sums)


def _position_order() -> Column:
    return F.struct("pos", "ident", "mate", "bwa_rank")


def cloud_facts(layout, df: DataFrame) -> DataFrame:
    """bad (a read occurs twice in the cloud), where that first shows, and the initial weight."""
    return layout.facts(df, CLOUD, {
        "bad": F.max("repeats"),
        "collision": F.min(F.when(F.col("repeats"), _position_order())),
        "weight": F.sum("gamma"),
    })


def entry_order() -> Column:
    """Sortable rank of the moment a candidate enters the sweep, comparable within a pair.

    Rows enter in cloud and position order, except that a colliding cloud re-enters its reads in
    name order from the collision on.
    """
    late = F.coalesce(_position_order() >= F.col("collision"), F.lit(False))
    early_only = lambda c: F.when(late, F.lit(0).cast("long")).otherwise(F.col(c).cast("long"))
    return F.struct(
        F.col("gcloud"), late.alias("late"), early_only("pos").alias("p"), F.col("mate"),
        early_only("bwa_rank").alias("r"),
    )


def with_support(layout, df: DataFrame, facts: dict[str, Column] | None = None) -> DataFrame:
    """Add support, the partner gamma of every candidate (both mates at once)."""
    of = {f"_support{m}": F.when(F.col("mate") == m, F.col("gamma")) for m in (0, 1)}
    df = layout.pair_pass(df, facts or {}, of)
    support = F.when(F.col("mate") == 0, F.col("_support1")).otherwise(F.col("_support0"))
    return df.withColumn("support", support).drop(*of)


def with_leader(layout, df: DataFrame) -> DataFrame:
    """Add leads (this mate entered the sweep after the other one and moves first) and support."""
    df = df.withColumn("_entry", entry_order())
    df = with_support(layout, df, {"_first": F.min_by("mate", "_entry")})
    return df.withColumn("leads", F.col("mate") != F.col("_first")).drop("_entry", "_first", "collision")


def _half_step(layout, df: DataFrame, moves: Column, last: bool) -> DataFrame:
    """Move gamma of the rows where ``moves``; their mates get the new support."""
    product = F.col("likelihood") * F.greatest(F.col("weight"), F.lit(_TINY)) * F.greatest(
        F.col("support"), F.lit(_NO_MATE))
    df = df.withColumn("_p", F.when(F.col("em") & moves, product))
    facts = {"_total": F.sum("_p")}
    if last:
        facts["_largest"] = F.max("_p")
    df = layout.pair_pass(df, facts, {"_partner": F.col("_p")})
    term = _floored(F.col("_p"), F.col("_largest")) if last else F.col("_p")
    moved = F.col("_p").isNotNull()
    return df.withColumns({
        "gamma": F.when(moved, term / F.col("_total")).otherwise(F.col("gamma")),
        "support": F.when(~moved & F.col("_total").isNotNull(), F.col("_partner") / F.col("_total"))
        .otherwise(F.col("support")),
    }).drop(*facts, "_partner", "_p")


def em(layout, df: DataFrame, rounds: int = EM_ROUNDS, min_pairs: int = EM_MIN_PAIRS) -> DataFrame:
    """gamma after ``rounds`` sweeps for barcodes with ``min_pairs`` read pairs or more."""
    df = df.withColumn("em", F.col("n_pairs") >= min_pairs)
    active = F.when(F.col("active"), F.col("gamma")).otherwise(F.lit(0.0))
    for r in range(rounds):
        last = r + 1 == rounds
        df = _half_step(layout, df, F.col("leads"), last)
        df = _half_step(layout, df, ~F.col("leads"), last)
        if not last:
            df = layout.facts(df, CLOUD, {"weight": F.sum(active)})
    return df




# Columns the sweeps read; everything else travels as one opaque struct, copied as a block.
_WORKING = [
    "bc", "ident", "mate", "bwa_rank", "chrom", "cloud", "pos", "gpos", "rev", "score", "active", "n_pairs",
]


def _sweep(layout, df: DataFrame, rounds: int, min_pairs: int) -> DataFrame:
    return em(layout, with_leader(layout, cloud_facts(layout, initialise(layout, df))), rounds, min_pairs)


def posterior(layout, clouded: DataFrame, rounds: int = EM_ROUNDS, min_pairs: int = EM_MIN_PAIRS) -> DataFrame:
    """Clouded candidates -> the same rows with gamma and bad."""
    rest = [c for c in clouded.columns if c not in _WORKING]
    if layout.reshuffles:
        return _spread(layout, clouded, rounds, min_pairs)
    packed = clouded.select(*_WORKING, F.struct(*rest).alias("rest")) if rest else clouded
    swept = _sweep(layout, packed, rounds, min_pairs)
    return swept.select(*_WORKING, *[F.col(f"rest.{c}").alias(c) for c in rest], "bad", "gamma")


def _spread(layout, clouded: DataFrame, rounds: int, min_pairs: int) -> DataFrame:
    """Read pairs that fit a task in blocks; the others, if there are any, by aggregates of their rows.  Both share the clouds' facts."""
    columns = [*_WORKING, *[c for c in clouded.columns if c not in _WORKING], "bad", "gamma"]
    with layout.by_pair_size(clouded) as (light, heavy), layout.packed(light, _WORKING) as packed:
        found = _in_blocks(layout, packed, heavy, rounds, min_pairs)
    return found.select(*columns)


def _in_blocks(layout, packed, heavy: DataFrame | None, rounds: int, min_pairs: int) -> DataFrame:
    types = {f.name: f.dataType for f in packed.schema}
    place = ["pos", "ident", "mate", "bwa_rank"]
    collision = T.StructType([T.StructField(c, types[c]) for c in place])
    facts = [T.StructField("bad", T.BooleanType()), T.StructField("collision", collision), T.StructField("weights", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("slot", T.IntegerType()), *[T.StructField(c, types[c]) for c in CLOUD],
        T.StructField("weight", T.DoubleType()), *facts])
    keyed = lambda df: df.where(F.col("chrom").isNotNull() & F.col("cloud").isNotNull())

    def first(block, data, state, rest):
        return Sweep(data).facts(block)

    def swept(data, state, done):
        found = Sweep(data)
        found.rounds(state, done, rounds, min_pairs)
        return found

    def nth(done):
        return lambda block, data, state, rest: swept(data, state, done).weights(block, state)

    def last(block, data, state):
        found = swept(data, state, rounds)
        return {"bad": found.bad(state), "gamma": pa.array(found.gamma, from_pandas=True)}

    def share(parts, aggregates, more):
        return layout.hold(shared(parts, CLOUD, {"weight": F.sum("weight"), **aggregates}, more))

    def told_of(table):
        past = F.concat(F.coalesce("weights", F.array().cast("array<double>")), F.array("weight"))
        return listed(table, {"bad": F.col("bad"), "collision": F.col("collision"), "weights": past})

    with ExitStack() as kept:
        own = None
        if heavy is not None:
            rows = kept.enter_context(layout.beside(initialise(layout, heavy.select(*_WORKING))))
            own = keyed(rows).groupBy(*CLOUD).agg(
                F.max("repeats").alias("bad"), F.min(F.when(F.col("repeats"), _position_order())).alias("collision"),
                F.sum("gamma").alias("weight"), F.count("*").alias("_n"))
        table, paths = share(packed.run(first, schema), {"bad": F.max("bad"), "collision": F.min("collision")}, own)
        for done in range(rounds):
            if heavy is not None:
                rows, own = _beside_blocks(layout, kept, rows, table, done, rounds, min_pairs)
            layout.release(paths)
            if done + 1 < rounds:
                table, paths = share(packed.run(nth(done + 1), schema, told_of(table)), {}, own)
        found = packed.rows(last, [T.StructField("bad", T.BooleanType()), T.StructField("gamma", T.DoubleType())], told_of(table))
        if heavy is None:
            return found
        rows = layout.settle(rows.select(*CANDIDATE, "gamma", "bad"))
    return found.unionByName(heavy.join(rows, CANDIDATE).select(*found.columns))


def _beside_blocks(layout, kept: ExitStack, rows: DataFrame, table: DataFrame, done: int, rounds: int, min_pairs: int) -> tuple[DataFrame, DataFrame]:
    """One round over rows that are in no block, with the weights of ``table``: (rows, their part of the clouds' weights)."""
    facts = ["weight", *(["bad", "collision"] if done == 0 else [])]
    known = table.where(F.col("block").isNull()).select(*CLOUD, *facts, "_n")
    spread_on = ["ident", "mate", "pos"]
    rows = attach_by_key(rows.drop(*facts), known, CLOUD, F.col("_n") > layout.threshold, spread_on).drop("_n")
    if done == 0:
        rows = with_leader(layout, rows).withColumn("em", F.col("n_pairs") >= min_pairs)
    for moves in (F.col("leads"), ~F.col("leads")):
        rows = _half_step(layout, rows, moves, done + 1 == rounds)
    rows = kept.enter_context(layout.beside(rows))
    active = F.when(F.col("active"), F.col("gamma")).otherwise(F.lit(0.0))
    own = rows.where(F.col("chrom").isNotNull() & F.col("cloud").isNotNull()).groupBy(*CLOUD).agg(
        F.sum(active).alias("weight"), F.count("*").alias("_n"))
    return rows, own
