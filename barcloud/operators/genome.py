"""Coordinates of a concatenated genome: intervals on both strands as places on contigs.

Aligners count positions through all contigs, one behind the other (``L`` bases), and then through their reverse
complement: position ``p`` from L on is the complement of ``2L - 1 - p``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcloud.config import SkewPolicy
from barcloud.operators.skew import bounded_dim

#: Contigs are looked up by bins of so many bases; a bin lists the contigs that begin or lie in it.
BIN = 1 << 20


def contig_bins(contigs: DataFrame, bin_size: int = BIN) -> DataFrame:
    """(bin, contigs): every contig under each bin it touches, sorted by start."""
    held = contigs.where("length > 0").select(F.struct("start", "length", "chrom_id", "name").alias("contig"))
    first, last = F.floor(F.col("contig.start") / bin_size), F.floor((F.col("contig.start") + F.col("contig.length") - 1) / bin_size)
    touched = held.select("contig", F.explode(F.sequence(first, last)).alias("bin"))
    return touched.groupBy("bin").agg(F.array_sort(F.collect_list("contig")).alias("contigs"))


def locate(intervals: DataFrame, contigs: DataFrame, begin: str = "rb", end: str = "re", bin_size: int = BIN,
           policy: SkewPolicy | None = None) -> DataFrame:
    """Adds ``chrom_id``, ``name``, ``pos`` and ``pos_end`` (1-based, leftmost and rightmost base) and ``rev``.

    An interval is half open, ``[begin, end)``.  One that is empty, leaves the genome, or crosses the end of a contig or of a
    strand has no place: the new columns are null.  Its contig is found through the bin of its leftmost base; where
    the bins are too many to broadcast they are joined by bin.
    """
    total = contigs.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    low, high = F.col(begin), F.col(end) - 1
    rev = low >= total
    inside = (low >= 0) & (high >= low) & (high < 2 * total) & (rev == (high >= total))
    left = F.when(rev, 2 * total - 1 - high).otherwise(low)
    right = F.when(rev, 2 * total - 1 - low).otherwise(high)
    span = intervals.withColumn("_span", F.when(inside, F.struct(left.alias("left"), right.alias("right"), rev.alias("rev"))))
    bins = contig_bins(contigs, bin_size)
    joined = span.withColumn("bin", F.floor(F.col("_span.left") / bin_size)).join(bounded_dim(bins, policy or SkewPolicy()), "bin", "left")
    holds = F.filter("contigs", lambda c: (c["start"] <= F.col("_span.left")) & (F.col("_span.right") < c["start"] + c["length"]))
    contig = F.get(holds, F.lit(0))
    place = lambda side: (F.col(f"_span.{side}") - contig["start"] + 1).alias("pos" if side == "left" else "pos_end")
    return joined.select(
        *intervals.columns, contig["chrom_id"].alias("chrom_id"), contig["name"].alias("name"), place("left"), place("right"),
        F.when(contig.isNotNull(), F.col("_span.rev")).alias("rev"))
