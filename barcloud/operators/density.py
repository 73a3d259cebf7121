"""Read-density optimisation of clouds in which a read occurs several times, as set-based steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barcloud.config import (
    DENSITY_BIN, DENSITY_MIN_RECORDS, DENSITY_ROUNDS, DENSITY_SCORE_SCALE, INSERT_MAX,
    SPLIT_EXTRA_SEARCH_DEPTH, Platform,
)
from barcloud.functions.alignment import log_density
from barcloud.operators.ascent import Ascent
from barcloud.operators.blocks import listed, shared
from barcloud.operators.candidates import CANDIDATE
from barcloud.operators.clouds import CLOUD

# Columns the ascent reads
_WORKING = [*CANDIDATE, "chrom", "cloud", "pos", "rev", "score", "clip_edit_dist", "active"]
IN_CLOUD = [*CLOUD, "ident", "mate"]


def prefilter(layout, clouded: DataFrame) -> DataFrame:
    """Deactivate hopeless repeats of a read in a colliding cloud; add ``anneal``.

    ``anneal`` marks the clouds to optimise: enough records before and after the cut, and a read
    that still has a choice.
    """
    df = layout.read_facts(clouded, IN_CLOUD, {"_copies": F.count("*"), "_least": F.min("clip_edit_dist")})
    df = layout.facts(df, CLOUD, {"_records": F.count("*"), "_colliding": F.max(F.col("_copies") > 1)})
    eligible = F.col("_colliding") & (F.col("_records") >= DENSITY_MIN_RECORDS)
    dropped = eligible & (F.col("clip_edit_dist") > F.col("_least") + SPLIT_EXTRA_SEARCH_DEPTH)
    df = df.withColumns({"_eligible": eligible, "active": F.col("active") & ~dropped})
    kept = F.when(F.col("active"), F.col("pos"))
    df = layout.read_facts(df, IN_CLOUD, {"_choices": F.count(kept)})
    df = layout.facts(df, CLOUD, {
        "_lo": F.min(kept), "_left": F.count(kept), "_most": F.max("_choices")})
    anneal = F.col("_eligible") & (F.col("_left") >= DENSITY_MIN_RECORDS) & (F.col("_most") > 1)
    return df.withColumn("anneal", F.coalesce(anneal, F.lit(False))).drop(
        "_copies", "_least", "_records", "_colliding", "_eligible", "_choices", "_left", "_most")


def density_bins(clouded: DataFrame) -> DataFrame:
    """(bc, chrom, cloud, bin, n): candidates per 1 kb bin of their cloud."""
    bin_of = F.floor((F.col("pos") - F.col("cloud")) / DENSITY_BIN)
    return clouded.groupBy(*CLOUD, bin_of.alias("bin")).agg(F.count("*").alias("n"))


def _ranked(df: DataFrame, platform: Platform, moving: Column) -> Column:
    """Sortable worth of a candidate of a moving read: next to its mate first, then score and density, then as it is."""
    mate = F.when(F.col("mate") == 0, F.col("_of1")).otherwise(F.col("_of0"))
    gap = F.when(F.col("rev"), F.col("pos") - mate["pos"]).otherwise(mate["pos"] - F.col("pos"))
    paired = F.coalesce((F.col("rev") != mate["rev"]) & gap.between(0, INSERT_MAX), F.lit(False))
    # the load of the bin without this read
    others = F.col("_load") - F.when(F.col("_bin") == F.col("_own"), 1).otherwise(0)
    value = F.col("score") / DENSITY_SCORE_SCALE + log_density(others + 1, platform) - log_density(others, platform)
    # equal worth is equal whatever the order of additions was
    worth = F.floor(value * 1e9 + 0.5).cast("long")
    return F.when(moving, F.struct(
        paired.alias("a"), worth.alias("b"), F.col("_chosen").alias("c"), (-F.col("pos")).alias("d"), (-F.col("bwa_rank")).alias("e")
    ))


def _digest() -> Column:
    """Its parity deals pairs to the halves: names may be text."""
    return F.ascii(F.right(F.md5(F.col("ident").cast("string")), F.lit(1)))


def optimise_density(layout, clouded: DataFrame, platform: Platform, rounds: int = DENSITY_ROUNDS) -> DataFrame:
    """``clouded`` with ``active`` set on exactly one candidate per read of every cloud to optimise.

    An ascent on score / 20 plus the log density of 1 kb bins, over sets: reads start at their best score;
    in each of ``rounds`` rounds first one half of the reads, then the other, moves each to its best
    candidate under the loads left by the half-step before.  The two mates of a pair are in different
    halves, so a read sees where its mate is, and a place next to it comes before any other.
    Every step is an aggregate per bin, per pair or per read, in any layout and for clouds of any size; read pairs of spread barcodes
    stay in blocks, and loads of bins travel.
    """
    if not layout.reshuffles:
        return _ascent(layout, clouded, platform, rounds)
    if layout.pairs_fit:
        return _in_blocks(layout, clouded, platform, rounds)
    # every step shuffles its rows: only the narrow columns, joined back on the unique key
    with layout.beside(clouded) as wide:
        found = _ascent(layout, wide.select(*_WORKING), platform, rounds).select(*CANDIDATE, "active")
    return wide.drop("active").join(found, CANDIDATE).select(*clouded.columns)


def _ascent(layout, clouded: DataFrame, platform: Platform, rounds: int) -> DataFrame:
    marked = prefilter(layout, clouded)
    ours = F.col("anneal") & F.col("active")
    best = F.max(F.when(ours, F.struct(
        F.floor(F.col("score") * 1e9 + 0.5).cast("long").alias("b"), (-F.col("pos")).alias("d"), (-F.col("bwa_rank")).alias("e"))))
    own = F.struct(
        F.floor(F.col("score") * 1e9 + 0.5).cast("long").alias("b"), (-F.col("pos")).alias("d"), (-F.col("bwa_rank")).alias("e"))
    df = marked.withColumn("_bin", F.floor((F.col("pos") - F.col("_lo")) / DENSITY_BIN))
    df = layout.read_facts(df, IN_CLOUD, {"_best": best})
    df = df.withColumn("_chosen", F.coalesce(ours & (own == F.col("_best")), F.lit(False))).drop("_best")
    pair = [*CLOUD, "ident"]
    for half in [0, 1] * rounds:
        place = F.struct("pos", "rev")
        df = layout.facts(df, [*CLOUD, "_bin"], {"_load": F.count(F.when(F.col("_chosen"), F.lit(1)))})
        # facts of both mates by pair: one sort order serves them and the choice below
        df = layout.read_facts(df, pair, {
            **{f"_of{m}": F.max(F.when(F.col("_chosen") & (F.col("mate") == m), place)) for m in (0, 1)},
            **{f"_own{m}": F.max(F.when(F.col("_chosen") & (F.col("mate") == m), F.col("_bin"))) for m in (0, 1)}})
        df = df.withColumn("_own", F.when(F.col("mate") == 0, F.col("_own0")).otherwise(F.col("_own1")))
        moving = ours & ((_digest() + F.col("mate")) % 2 == half)
        df = df.withColumn("_rank", _ranked(df, platform, moving))
        df = layout.read_facts(df, pair, {f"_best{m}": F.max(F.when(F.col("mate") == m, F.col("_rank"))) for m in (0, 1)})
        best = F.when(F.col("mate") == 0, F.col("_best0")).otherwise(F.col("_best1"))
        moved = F.coalesce(F.col("_rank") == best, F.lit(False))
        df = df.withColumn("_chosen", F.when(moving, moved).otherwise(F.col("_chosen")))
        df = df.drop("_load", "_of0", "_of1", "_own", "_own0", "_own1", "_rank", "_best0", "_best1")
    active = F.when(ours, F.col("_chosen")).otherwise(F.col("active"))
    return df.withColumn("active", active).drop("_chosen", "_bin", "anneal", "_lo")


def _in_blocks(layout, clouded: DataFrame, platform: Platform, rounds: int) -> DataFrame:
    """The ascent over blocks of read pairs; facts of clouds and loads of bins travel between them."""
    types = {f.name: f.dataType for f in clouded.schema}
    number, flag = T.LongType(), T.BooleanType()
    made = lambda extra: T.StructType([
        T.StructField("block", number), T.StructField("slot", T.IntegerType()), *[T.StructField(c, types[c]) for c in CLOUD],
        *[T.StructField(name, kind) for name, kind in extra.items()]])
    first = {"records": number, "colliding": flag}
    second = {"lo": number, "left": number, "most": number, **first}
    cells = {"bin": number, "load": number, "loads": T.ArrayType(number)}
    columns = lambda names: {name: F.col(name) for name in names}

    def laid(data, state):
        found = Ascent(data)
        found.cut(state)
        found.lay(state, platform)
        return found

    def climbed(data, state, done):
        found = laid(data, state)
        past = state and state["loads"].values
        found.climb(list(np.array(past.to_pylist() if past else [], np.int64).reshape(-1, done).T))
        return found, past

    def choices(block, data, state, rest):
        found = Ascent(data)
        found.cut(state)
        return found.choices(block, state)

    def nth(done):
        if not done:
            return lambda block, data, state, rest: laid(data, state).loads(block, None)

        def step(block, data, state, rest):
            found, past = climbed(data, state, done)
            return found.loads(block, past)

        return step

    def last(block, data, state):
        return {"active": climbed(data, state, 2 * rounds)[0].result()}

    marked = clouded.withColumn("_parity", _digest() % 2)
    with layout.packed(marked, [*_WORKING, "_parity"]) as packed:
        table = layout.settle(shared(packed.run(lambda block, data, state, rest: Ascent(data).collisions(block), made(first)), CLOUD, {
            "records": F.sum("records"), "colliding": F.max("colliding")}))
        facts = shared(packed.run(choices, made(second), listed(table, columns(first))), CLOUD, {
            "lo": F.min("lo"), "left": F.sum("left"), "most": F.max("most")})
        with layout.beside(facts) as table:
            of_clouds = told = listed(table, columns(second))
            for done in range(2 * rounds):
                loads = layout.settle(shared(packed.run(nth(done), made(cells), told), [*CLOUD, "bin"], {"load": F.sum("load")}))
                past = F.concat(F.coalesce("loads", F.array().cast("array<bigint>")), F.array("load"))
                of_bins = listed(loads, {"loads": past}).withColumnRenamed("size", "_bins")
                told = of_clouds.join(of_bins, "block", "left").withColumn("size", F.col("size") + F.coalesce("_bins", F.lit(0))).drop("_bins")
        done = packed.rows(last, [T.StructField("active", flag)], told)
    return done.select(*clouded.columns)
