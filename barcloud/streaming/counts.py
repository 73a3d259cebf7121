"""Barcode counts and event sessions as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcloud.config import BC_LEN
from barcloud.functions import bases as B
from barcloud.operators.counting import is_usable


def barcode_counts(reads: DataFrame, whitelist: DataFrame | None = None) -> DataFrame:
    """Running reads per N-free barcode of a stream of pairs (complete or update mode).

    With a static ``whitelist`` (bc) other barcodes are dropped before they are counted: state is
    one row per listed barcode.  Without it, erroneous barcodes have a row each.
    """
    bases = B.normalize_bases(F.substring("r1", 1, BC_LEN))
    coded = reads.where(is_usable()).select(bases.alias("bases")).where(B.n_count("bases") == 0)
    packed = coded.select(B.pack("bases").alias("bc"))
    if whitelist is not None:
        packed = packed.join(whitelist.select("bc"), "bc", "left_semi")
    return packed.groupBy("bc").agg(F.count("*").alias("n"))


def whitelisted(counts: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Restrict one micro-batch of counts to the whitelist (use inside ``foreachBatch``)."""
    return counts.join(whitelist, "bc", "left_semi")


def sessions(events: DataFrame, key: str, time: str, gap: str, watermark: str) -> DataFrame:
    """Event-time islands: the streaming form of cloud building over a time axis."""
    window = F.session_window(time, gap)
    grouped = events.withWatermark(time, watermark).groupBy(key, window.alias("session"))
    return grouped.agg(F.count("*").alias("n")).select(
        key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")
