"""Molecule clouds: single-linkage islands of candidate positions per barcode and contig.

A cloud is named by its smallest position (``cloud``), so it needs no running counter and the
(bc, chrom, cloud) key is the same whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barcloud.config import DEFAULT_POLICY, SkewPolicy
from barcloud.operators.skew import attach_small
from barcloud.session import cut_lineage

CLOUD = ["bc", "chrom", "cloud"]
_CONTIG = ["bc", "chrom"]
_ROWS_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def build_clouds(candidates: DataFrame, dist_thresh: int) -> DataFrame:
    """Add ``cloud`` with windows keyed by barcode: for barcodes that fit one task."""
    w = Window.partitionBy(*_CONTIG).orderBy("pos")
    starts = F.coalesce(F.col("pos") - F.lag("pos").over(w) > dist_thresh, F.lit(True))
    marked = candidates.withColumn("_start", F.when(starts, F.col("pos")))
    return marked.withColumn("cloud", F.max("_start").over(w.rowsBetween(*_ROWS_SO_FAR))).drop("_start")


def _stitched(bins: DataFrame, group: list[str], dist_thresh: int) -> DataFrame:
    """Add ``cloud`` to one-row-per-bin summaries (_bin, _lo, _hi) with bins of ``dist_thresh``.

    Positions of one bin are closer than dist_thresh, so only the first of a bin can start a
    cloud.  A group has at most axis length / dist_thresh bins, whatever the number of rows.
    """
    along = Window.partitionBy(*group).orderBy("_bin")
    starts = F.coalesce(F.col("_lo") - F.lag("_hi").over(along) > dist_thresh, F.lit(True))
    marked = bins.withColumn("_start", F.when(starts, F.col("_lo")))
    return marked.withColumn("cloud", F.max("_start").over(along.rowsBetween(*_ROWS_SO_FAR))).drop("_start")


def build_clouds_spread(
    candidates: DataFrame, dist_thresh: int, total_rows: int, policy: SkewPolicy = DEFAULT_POLICY,
    settle: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Add ``cloud`` without ever bringing a whole barcode, contig or cloud to one task; ``settle`` writes the bins."""
    binned = candidates.withColumn("_bin", F.floor(F.col("pos") / dist_thresh))
    bins = binned.groupBy(*_CONTIG, "_bin").agg(
        F.min("pos").alias("_lo"), F.max("pos").alias("_hi"), F.count("*").alias("_n"))
    stitched = settle(_stitched(bins, _CONTIG, dist_thresh).drop("_lo", "_hi"))
    heavy = F.col("_n") > policy.threshold(total_rows)
    return attach_small(binned, stitched, [*_CONTIG, "_bin"], heavy, ["ident", "pos"], policy).drop("_bin", "_n")


def island_totals(rows: DataFrame, key: str, axis: str, gap: int, value: str) -> DataFrame:
    """(key, cloud, last, n, total) of the islands along any axis.

    Rows are only pre-aggregated per bin; islands are then made of bins, so a key with a third of
    all rows costs no more than its number of bins.
    """
    bins = rows.groupBy(key, F.floor(F.col(axis) / gap).alias("_bin")).agg(
        F.min(axis).alias("_lo"), F.max(axis).alias("_hi"), F.count("*").alias("n"), F.sum(value).alias("total"))
    return _stitched(bins, [key], gap).groupBy(key, "cloud").agg(
        F.max("_hi").alias("last"), F.sum("n").alias("n"), F.sum("total").alias("total"))


def cloud_summary(clouded: DataFrame) -> DataFrame:
    return clouded.groupBy(*CLOUD).agg(
        F.count("*").alias("n_candidates"), F.max("pos").alias("hi"),
        F.countDistinct("ident").alias("n_pairs"))


def collisions(clouded: DataFrame) -> DataFrame:
    """Reads with several candidates in one cloud."""
    return clouded.groupBy(*CLOUD, "ident", "mate").agg(F.count("*").alias("n")).where("n > 1")


def consecutive_runs(reads: DataFrame, value: str, order: str, max_bins: int = 65_536) -> DataFrame:
    """(run_start, value, n): runs of equal consecutive values along a numeric read order.

    The order is cut in at most ``max_bins`` bins of similar numbers of rows: they are the partitions
    of a range partitioning, so outlying values make no bin large.  Runs are found inside bins; what a bin
    inherits from its predecessors comes from one summary row per bin, so the only unpartitioned
    window and the broadcast are bounded by ``max_bins`` whatever the size of the data.
    """
    tasks = min(max_bins, int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    binned = cut_lineage(
        reads.select(order, value).repartitionByRange(tasks, order).withColumn("_bin", F.spark_partition_id()))
    inside = Window.partitionBy("_bin").orderBy(order)
    before = Window.orderBy("_bin")

    edges = binned.groupBy("_bin").agg(F.max_by(value, order).alias("_last")).withColumn(
        "_inherited", F.lag(F.struct(F.col("_last").alias("v"))).over(before))
    previous = F.coalesce(
        F.lag(F.struct(F.col(value).alias("v"))).over(inside), F.col("_inherited"))
    marked = (
        binned.join(F.broadcast(edges.select("_bin", "_inherited")), "_bin")
        .withColumn("_start", F.when(previous.isNull() | ~previous["v"].eqNullSafe(F.col(value)), F.col(order)))
    )
    opened = marked.groupBy("_bin").agg(F.max("_start").alias("_opened")).withColumn(
        "_carried", F.max("_opened").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    local = F.max("_start").over(inside.rowsBetween(*_ROWS_SO_FAR))
    runs = (
        marked.withColumn("_local", local)
        .join(F.broadcast(opened.select("_bin", "_carried")), "_bin")
        .withColumn("run_start", F.coalesce("_local", "_carried"))
    )
    return runs.groupBy("run_start", value).agg(F.count("*").alias("n"))
