"""The count stage: raw read pairs -> barcode histograms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from barcloud.operators import counting
from barcloud.session import cut_lineage


@dataclass(frozen=True)
class Counts:
    """Quality-aware keys (None for header-coded barcodes) and whitelisted barcode counts."""

    keys: DataFrame | None
    barcodes: DataFrame


def count(reads: DataFrame, whitelist: DataFrame | None = None, haplotag: bool = False) -> Counts:
    """One scan of the reads; the exact counts are derived from the aggregated keys."""
    if haplotag:
        return Counts(None, counting.haplotag_counts(reads))
    keys = cut_lineage(counting.quality_key_counts(reads))
    return Counts(keys, counting.whitelisted_counts(keys, whitelist))
