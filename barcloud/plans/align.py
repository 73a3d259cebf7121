"""From candidate alignments to one resolved, duplicate-marked alignment per read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcloud.config import DEFAULT_PLATFORM, DEFAULT_POLICY, EM_MIN_PAIRS, EM_ROUNDS, Platform, SkewPolicy, get_platform
from barcloud.operators import density as D
from barcloud.operators.candidates import prepare
from barcloud.operators.em import initialise, posterior, with_support
from barcloud.operators.layout import BarcodeLocal, Spread, SpreadReads, even_tasks
from barcloud.operators.selection import best_alignments, mark_duplicates, with_mates
from barcloud.session import cut_lineage


_LAYOUTS = {"local": BarcodeLocal, "spread": Spread, "spread_reads": SpreadReads}


def plan_layouts(candidates: DataFrame, policy: SkewPolicy = DEFAULT_POLICY, layout: str = "auto"):
    """[(layout, rows)] covering all candidates: light barcodes local, heavy ones spread.

    One narrow pass counts rows per read pair and barcode; only the barcodes above the policy's
    threshold (at most ``max_heavy_keys``) reach the driver.
    """
    pairs = candidates.groupBy("bc", "ident").agg(F.count("*").alias("n"))
    sizes = cut_lineage(pairs.groupBy("bc").agg(F.sum("n").alias("n"), F.max("n").alias("pair")))
    n, largest, missing = sizes.agg(F.sum("n"), F.max("n"), F.max(F.when(F.col("bc").isNull(), F.col("n")))).first()
    if missing:
        raise ValueError(f"{missing} candidates have no barcode; align reads without barcode separately")
    total = n or 0
    limit = policy.threshold(total)
    kinds = {kind: make(policy, total) for kind, make in _LAYOUTS.items()}
    light = sizes if layout == "local" else sizes.where(F.col("n") <= limit)
    if total > policy.rows_per_task:
        kinds["local"] = BarcodeLocal(policy, total, even_tasks(light, policy, total))
    if layout != "auto":
        return [(kinds[layout], candidates)]
    if (largest or 0) <= limit:
        return [(kinds["local"], candidates)]
    # at most max_heavy_keys rows can pass
    heavy = sizes.where(F.col("n") > limit).select("bc", (F.col("pair") > limit).alias("reads")).collect()
    parts = []
    spark = candidates.sparkSession
    table = lambda rows: F.broadcast(spark.createDataFrame([(r.bc,) for r in rows], "bc long"))
    parts.append((kinds["local"], candidates.join(table(heavy), "bc", "left_anti")))
    for kind, reads in (("spread", False), ("spread_reads", True)):
        chosen = [r for r in heavy if r.reads == reads]
        if chosen:
            parts.append((kinds[kind], candidates.join(table(chosen), "bc", "left_semi")))
    return parts


def _over_layouts(candidates: DataFrame, policy, layout, step) -> DataFrame:
    parts = [step(lay, rows) for lay, rows in plan_layouts(candidates, policy, layout)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _clouded(
    lay, rows: DataFrame, platform: Platform, compat: bool, density: bool, pair_counts: DataFrame | None = None,
) -> DataFrame:
    placed = lay.pair_counts(lay.place(rows), pair_counts)
    clouded = lay.build_clouds(prepare(placed, platform, compat, lay.read_facts), platform.dist_thresh)
    return D.optimise_density(lay, clouded, platform) if density else clouded


def clouded_candidates(
    candidates: DataFrame, platform: Platform | str = DEFAULT_PLATFORM, compat: bool = False,
    policy: SkewPolicy = DEFAULT_POLICY, layout: str = "auto",
) -> DataFrame:
    """Admitted candidates with their cloud."""
    platform = get_platform(platform) if isinstance(platform, str) else platform
    step = lambda lay, rows: _clouded(lay, rows, platform, compat, False)
    return _over_layouts(candidates, policy, layout, step)


def initial_state(
    candidates: DataFrame, platform: Platform | str = DEFAULT_PLATFORM, support: bool = False,
    policy: SkewPolicy = DEFAULT_POLICY, layout: str = "auto",
) -> DataFrame:
    """Clouded candidates with gamma from scores alone (and the support of their mates)."""
    platform = get_platform(platform) if isinstance(platform, str) else platform

    def step(lay, rows):
        df = initialise(lay, _clouded(lay, rows, platform, False, False))
        return with_support(lay, df) if support else df

    return _over_layouts(candidates, policy, layout, step)


def density_decisions(
    candidates: DataFrame, platform: Platform | str = DEFAULT_PLATFORM, anneal: bool = True,
    policy: SkewPolicy = DEFAULT_POLICY, layout: str = "auto",
) -> DataFrame:
    """Clouded candidates with ``active`` as the density optimisation (or its prefilter) leaves it."""
    platform = get_platform(platform) if isinstance(platform, str) else platform

    def step(lay, rows):
        clouded = _clouded(lay, rows, platform, False, False)
        return D.optimise_density(lay, clouded, platform) if anneal else D.prefilter(lay, clouded)

    return _over_layouts(candidates, policy, layout, step)


def posteriors(
    candidates: DataFrame, platform: Platform | str = DEFAULT_PLATFORM, rounds: int = EM_ROUNDS,
    compat: bool = False, density: bool = False, policy: SkewPolicy = DEFAULT_POLICY, layout: str = "auto",
    pair_counts: DataFrame | None = None, min_pairs: int = EM_MIN_PAIRS,
) -> DataFrame:
    """Admitted candidates with gamma, cloud and bad; see ``resolve`` for the last two options."""
    platform = get_platform(platform) if isinstance(platform, str) else platform
    step = lambda lay, rows: posterior(lay, _clouded(lay, rows, platform, compat, density, pair_counts), rounds, min_pairs)
    return _over_layouts(candidates, policy, layout, step)


def resolve(
    candidates: DataFrame, platform: Platform | str = DEFAULT_PLATFORM, compat: bool = False,
    density: bool = False, policy: SkewPolicy = DEFAULT_POLICY, layout: str = "auto",
    pair_counts: DataFrame | None = None, min_pairs: int = EM_MIN_PAIRS,
) -> DataFrame:
    """One row per aligned read: best candidate, gamma, alt, mate_aln, duplicate.

    ``mi`` numbers the clouds of a barcode, so (BX, MI) names a molecule.  Expectation-maximisation runs for
    barcodes with ``min_pairs`` read pairs or more: by ``pair_counts`` (bc, n_pairs), which counts all pairs
    of the reads (``read_pair_counts``), or, without it, by the pairs that have a candidate.
    """
    platform = get_platform(platform) if isinstance(platform, str) else platform

    def step(lay, rows):
        scored = posterior(lay, _clouded(lay, rows, platform, compat, density, pair_counts), min_pairs=min_pairs)
        selected = lay.ordinal(with_mates(best_alignments(lay, scored)), "mi")
        return mark_duplicates(lay, selected, platform)

    return _over_layouts(candidates, policy, layout, step)


def read_pair_counts(reads: DataFrame) -> DataFrame:
    """(bc, n_pairs): read pairs per barcode, aligned or not."""
    return reads.where(F.col("bc").isNotNull()).groupBy("bc").agg(F.count("*").alias("n_pairs"))
