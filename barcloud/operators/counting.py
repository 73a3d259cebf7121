"""Barcode counting: exact, quality-aware and total counts of raw read pairs.

``reads`` has one row per pair: name, r1, q1, name2, r2, q2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barcloud.config import BC_LEN, MIN_READ_SIZE
from barcloud.functions import bases as B
from barcloud.functions import headers as H


def is_usable(haplotag: bool = False) -> Column:
    """Pairs that take part: long enough and with a readable barcode."""
    long_enough = F.length("r1") >= MIN_READ_SIZE
    if haplotag:
        return F.coalesce(long_enough & B.pack_haplotag(H.bx_tag("name")).isNotNull(), F.lit(False))
    return F.coalesce(long_enough & B.quals_in_range("q1"), F.lit(False))


def with_key(reads: DataFrame) -> DataFrame:
    """Add the barcode bases and saturated qualities of mate 1."""
    return reads.withColumns(
        {"bases": B.normalize_bases(F.substring("r1", 1, BC_LEN)), "quals": B.saturate_quals("q1")}
    )


def quality_key_counts(reads: DataFrame) -> DataFrame:
    """(bases, quals, n): reads per quality-aware barcode key."""
    usable = with_key(reads.where(is_usable()).select("r1", "q1"))
    return usable.groupBy("bases", "quals").agg(F.count("*").alias("n"))


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Sum several count tables of the same shape into one."""
    merged = counts[0]
    for other in counts[1:]:
        merged = merged.unionByName(other)
    keys = [c for c in merged.columns if c != "n"]
    return merged.groupBy(*keys).agg(F.sum("n").alias("n"))


def exact_counts(keys: DataFrame) -> DataFrame:
    """(bc, n) over quality-aware keys without N, before any whitelist."""
    clean = keys.where(B.n_count("bases") == 0).select(B.pack("bases").alias("bc"), "n")
    return clean.groupBy("bc").agg(F.sum("n").alias("n"))


def whitelisted_counts(keys: DataFrame, whitelist: DataFrame) -> DataFrame:
    """(bc, n) of whitelisted barcodes.  Aggregated first: the join sees one row per barcode."""
    return exact_counts(keys).join(whitelist, "bc", "left_semi")


def haplotag_counts(reads: DataFrame) -> DataFrame:
    """(bc, n) of header-coded barcodes; the generated whitelist is a predicate."""
    coded = reads.where(is_usable(haplotag=True)).select(B.pack_haplotag(H.bx_tag("name")).alias("bc"))
    return coded.where(B.is_haplotag_code("bc")).groupBy("bc").agg(F.count("*").alias("n"))


def read_totals(reads: DataFrame, whitelist: DataFrame) -> DataFrame:
    """One row: nice_reads, total_reads, ignored_reads, n_bytes (uncompressed FASTQ size)."""
    line_bytes = sum((F.length(c) for c in ("name", "r1", "q1", "name2", "r2", "q2")), F.lit(0))
    # '+' separator lines carry one character; each of the 8 lines ends with a newline
    sized = with_key(reads).select(
        F.when(is_usable(), F.col("bases")).alias("bases"), (line_bytes + 10).cast("long").alias("size")
    )
    per_barcode = sized.groupBy("bases").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    known = whitelist.select("bc", F.lit(True).alias("known"))
    coded = per_barcode.withColumn("bc", F.when(B.n_count("bases") == 0, B.pack("bases")))
    usable = F.col("bases").isNotNull()
    return coded.join(known, "bc", "left").agg(
        F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("nice_reads"),
        F.coalesce(F.sum(F.when(usable, F.col("n"))), F.lit(0)).alias("total_reads"),
        F.coalesce(F.sum(F.when(~usable, F.col("n"))), F.lit(0)).alias("ignored_reads"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"),
    )


def check_whitelist(whitelist: DataFrame) -> DataFrame:
    """Fail on the all-A barcode (code 0), which stands for 'none' downstream."""
    bad = F.raise_error(F.lit("a barcode of sixteen A stands for none and may not be whitelisted")).cast("long")
    return whitelist.select(F.when(F.col("bc") == 0, bad).otherwise(F.col("bc")).alias("bc"))
