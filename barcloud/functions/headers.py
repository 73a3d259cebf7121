"""Barcode extraction from read headers, one rule per platform."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barcloud.functions.bases import _col, pack, pack_haplotag
from barcloud.config import Platform

_INT_PREFIX = r"^\s*([+-]?\d+)"


def name_only(header) -> Column:
    """Header up to its first whitespace."""
    return F.regexp_extract(_col(header), r"^(\S*)", 1)


def _leading_int(text: Column) -> Column:
    """C ``atoi``: leading integer, 0 when there is none."""
    return F.coalesce(F.regexp_extract(text, _INT_PREFIX, 1).try_cast("long"), F.lit(0).cast("long"))


def _after_last_colon(text: Column) -> Column:
    return F.substring_index(text, ":", -1)


def _before_last_colon(text: Column) -> Column:
    return F.regexp_extract(text, r"^(.*):[^:]*$", 1)


def _first_word(text: Column) -> Column:
    return F.substring_index(text, " ", 1)


def bx_tag(header) -> Column:
    """12-character BX:Z: value after the first blank or tab; NULL without a complete one."""
    return F.nullif(F.regexp_extract(_col(header), r"^[^ \t]*[ \t].*?BX:Z:(.{12})", 1), F.lit(""))


def split_header(header, platform: Platform) -> tuple[Column, Column]:
    """(barcode text, read identifier) of a header line of the given platform."""
    header = _col(header)
    if platform.name == "tru":
        return F.regexp_replace(header, "^@", ""), header
    if platform.name == "cpt":
        return F.substring(_after_last_colon(header), 3, 1 << 20), _before_last_colon(header)
    if platform.name == "tellseq":
        word = _first_word(header)
        tagged = header.startswith(F.concat(word, F.lit(" BX:Z:")))
        text = F.when(tagged, _after_last_colon(header)).otherwise(_after_last_colon(word))
        return text, F.when(tagged, word).otherwise(_before_last_colon(word))
    return _after_last_colon(header), _first_word(_before_last_colon(header))


def encode(text, platform: Platform) -> Column:
    """Numeric barcode of an extracted barcode text."""
    text = _col(text)
    if platform.name in ("tru", "cpt"):
        return _leading_int(text)
    if platform.name == "haplotag":
        return pack_haplotag(text)
    return pack(F.substring(text, 1, platform.bc_len))


def extract_barcode(header, platform: Platform) -> Column:
    return encode(split_header(header, platform)[0], platform)


def identifier(name) -> Column:
    """Read name without its leading '@'."""
    return F.regexp_replace(_col(name), "^@", "")
