"""The preproc stage: counts -> corrections -> balanced buckets -> routed reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcloud.config import DEFAULT_POLICY, SkewPolicy
from barcloud.operators import buckets as K
from barcloud.operators import correction
from barcloud.operators.skew import fits_broadcast
from barcloud.plans.count import Counts
from barcloud.session import cut_lineage


@dataclass(frozen=True)
class Corrections:
    decisions: DataFrame   # one row per quality-aware key
    priors: DataFrame      # one row per whitelisted barcode
    broadcast: bool        # whitelist proven small enough to broadcast


def correct(
    counts: Counts, whitelist: DataFrame, double: bool = False, policy: SkewPolicy = DEFAULT_POLICY,
    broadcast: bool | None = None,
) -> Corrections:
    """Correct distinct keys, not reads.

    Keys, priors and decisions feed several later joins, so each is computed once and cut.
    """
    if broadcast is None:
        broadcast = fits_broadcast(whitelist, policy)
    priors = cut_lineage(correction.barcode_priors(whitelist, counts.barcodes))
    decisions = correction.correct_keys(counts.keys, priors, double, policy, broadcast)
    return Corrections(decisions, priors, broadcast)


def bucket_counts(corrections: Corrections) -> DataFrame:
    """Accepted reads of every whitelisted barcode, zero counts included."""
    counted = correction.corrected_counts(corrections.decisions)
    return corrections.priors.select("bc").join(counted, "bc", "left").select("bc", F.coalesce("n", F.lit(0)).alias("n"))


def route(
    reads: DataFrame, corrections: Corrections, n_buckets: int, double: bool = False,
    policy: SkewPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Every usable pair with its final barcode and bucket."""
    return route_with_load(reads, corrections, n_buckets, double, policy)[0]


def route_with_load(
    reads: DataFrame, corrections: Corrections, n_buckets: int, double: bool = False,
    policy: SkewPolicy = DEFAULT_POLICY,
) -> tuple[DataFrame, DataFrame]:
    """``route`` and the pairs (bucket, n) each bucket will get, which the distinct keys already tell."""
    settled = Corrections(cut_lineage(corrections.decisions), corrections.priors, corrections.broadcast)
    buckets = cut_lineage(K.assign_buckets(bucket_counts(settled), n_buckets))
    replacements = correction.replacement_map(settled.decisions)
    routed = K.route_reads(reads, buckets, replacements, double, policy, settled.broadcast)
    bucket = F.coalesce("bucket", F.lit(0)).alias("bucket")
    # accepted keys are counted with their bucket, all others go to bucket 0
    placed = buckets.groupBy("bucket").agg(F.sum("n").alias("n"))
    rest = settled.decisions.where(F.col("assigned").isNull()).agg(F.sum("n").alias("n"))
    return routed, placed.select(bucket, "n").unionByName(rest.select(F.lit(0).alias("bucket"), F.coalesce("n", F.lit(0)).alias("n")))


def route_haplotag(reads: DataFrame, counts: Counts, n_buckets: int) -> tuple[DataFrame, DataFrame]:
    """Header-coded barcodes need no correction; counts decide the buckets and tell their load."""
    buckets = cut_lineage(K.assign_buckets(counts.barcodes, n_buckets))
    return K.route_haplotag(reads, buckets), buckets.groupBy("bucket").agg(F.sum("n").alias("n"))
