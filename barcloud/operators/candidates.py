"""Admission of candidate alignments.

Input contract (any aligner): bc, ident, mate (0/1), bwa_rank, chrom (INT code), pos (1-based),
rev (BOOLEAN), edit_dist, clip, read_len, bwa_mapq, and the CIGAR as ``cigar`` array; or the
columns match_len / indel_runs / indel_len directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barcloud.config import EXTRA_SEARCH_DEPTH, GENOME_STRIDE, Platform
from barcloud.functions import alignment as A

READ = ["bc", "ident", "mate"]
PAIR = ["bc", "ident"]
CANDIDATE = ["bc", "ident", "mate", "bwa_rank"]  # unique


def with_scores(candidates: DataFrame, platform: Platform) -> DataFrame:
    """Add score, score_mapq and clip_edit_dist."""
    if "cigar" in candidates.columns:
        scores = A.score_columns("cigar", "edit_dist", platform)
    else:
        mismatches = F.col("edit_dist") - F.col("indel_len")
        scores = {
            "score": A.log_likelihood(F.col("match_len") - mismatches, mismatches, "indel_runs", "clip", platform),
            "score_mapq": A.score_quality(mismatches, "indel_runs", "clip", platform),
        }
    return candidates.withColumns({**scores, "clip_edit_dist": F.col("edit_dist") + F.col("clip")})


def _read_windows(df: DataFrame, keys: list[str], facts: dict[str, Column]) -> DataFrame:
    group = Window.partitionBy(*keys)
    return df.withColumns({name: agg.over(group) for name, agg in facts.items()})


def admit(candidates: DataFrame, compat: bool = False, read_facts=_read_windows) -> DataFrame:
    """Drop mostly clipped candidates and those far worse than the read's first hit.

    The baseline is the first surviving hit of the same mate.  With ``compat`` it is rank 0 only:
    -1 when rank 0 was clipped away on mate 0, and whatever mate 0 used when that happens on mate 1.
    ``read_facts(rows, keys, facts)`` attaches facts of a read the way the layout asks for.
    """
    kept = candidates.where(F.col("clip") < F.floor(F.col("read_len") / 2))
    excess = F.col("clip_edit_dist") - F.col("_base") <= EXTRA_SEARCH_DEPTH
    if not compat:
        based = read_facts(kept, READ, {"_base": F.min_by("clip_edit_dist", "bwa_rank")})
        return based.where(excess).drop("_base")
    rank0 = lambda m: F.max(F.when((F.col("mate") == m) & (F.col("bwa_rank") == 0), F.col("clip_edit_dist")))
    based = read_facts(kept, PAIR, {"_base0": rank0(0), "_base1": rank0(1)})
    first = F.coalesce("_base0", F.lit(-1))
    baseline = F.when(F.col("mate") == 0, first).otherwise(F.coalesce("_base1", first))
    keep = (F.col("bwa_rank") == 0) | excess
    return based.withColumn("_base", baseline).where(keep).drop("_base", "_base0", "_base1")


def prepare(
    candidates: DataFrame, platform: Platform, compat: bool = False, read_facts=_read_windows
) -> DataFrame:
    """Scored, admitted candidates with the fields later stages rely on."""
    admitted = admit(with_scores(candidates, platform), compat, read_facts)
    if "active" not in admitted.columns:
        admitted = admitted.withColumn("active", F.lit(True))
    return admitted.withColumn("gpos", F.col("chrom").cast("long") * F.lit(GENOME_STRIDE) + F.col("pos"))
