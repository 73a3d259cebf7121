"""Linked-read (barcoded short-read) analytics expressed as Spark DataFrame jobs."""

from barcloud.config import PLATFORMS, Platform, SkewPolicy, get_platform

__all__ = ["PLATFORMS", "Platform", "SkewPolicy", "get_platform"]
