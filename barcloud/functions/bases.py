"""Barcode and base-sequence functions; Column in, Column out, no Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barcloud.config import BC_LEN, HAPLOTAG_SEGMENT_MAX, MAX_QUAL, PHRED_OFFSET

_SATURATED = chr(PHRED_OFFSET + MAX_QUAL)
_ABOVE = "".join(chr(c) for c in range(ord(_SATURATED) + 1, 128))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_bases(seq) -> Column:
    """Upper-case; anything but ACGTN reads as A."""
    return F.regexp_replace(F.upper(_col(seq)), "[^ACGTN]", "A")


def pack(seq) -> Column:
    """2-bit pack, first base in the high bits; non-ACGT packs as A."""
    digits = F.translate(F.regexp_replace(F.upper(_col(seq)), "[^ACGT]", "A"), "ACGT", "0123")
    return F.conv(digits, 4, 10).cast("long")


def pack_little_endian(seq) -> Column:
    """2-bit pack, first base in the low bits."""
    return pack(F.reverse(_col(seq)))


def unpack(code, length: int = BC_LEN) -> Column:
    quaternary = F.lpad(F.conv(_col(code).cast("string"), 10, 4), length, "0")
    return F.translate(quaternary, "0123", "ACGT")


def unpack_little_endian(code, length: int = BC_LEN) -> Column:
    return F.reverse(unpack(code, length))


def base_digits(seq) -> Column:
    """Per-base codes A..T = 0..3 and N = 4, as a digit string."""
    return F.translate(normalize_bases(seq), "ACGTN", "01234")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``."""
    return F.transform(F.array(value), body)[0]


_HAPLOTAG = r"^A(\d\d)C(\d\d)B(\d\d)D(\d\d).*$"


def pack_haplotag(tag) -> Column:
    """AxxCxxBxxDxx -> A, C, B, D as the bytes of a 32-bit code; NULL when malformed."""
    digits = F.regexp_replace(_col(tag), _HAPLOTAG, "$1$2$3$4").try_cast("long")
    segment = lambda n, unit: F.floor(n / unit) % 100
    code = lambda n: (segment(n, 1_000_000) * (1 << 24) + segment(n, 10_000) * (1 << 16)
                      + segment(n, 100) * (1 << 8) + n % 100)
    return _let(digits, lambda n: F.when(n < 100_000_000, code(n)))


def _haplotag_byte(code: Column, shift: int) -> Column:
    return F.shiftright(code, shift).bitwiseAND(F.lit(127))


def unpack_haplotag(code) -> Column:
    text = lambda c: F.format_string(
        "A%02dC%02dB%02dD%02d", *[_haplotag_byte(c, s).cast("int") for s in (24, 16, 8, 0)])
    return _let(_col(code), lambda c: F.when(c.isNotNull(), text(c)))


def is_haplotag_code(code) -> Column:
    """Membership in the generated 96**4 whitelist, as a predicate instead of 85 M rows."""
    def listed(c):
        test = F.lit(True)
        for shift in (24, 16, 8, 0):
            test = test & F.shiftright(c, shift).bitwiseAND(F.lit(255)).between(1, HAPLOTAG_SEGMENT_MAX)
        return test

    return _let(_col(code), listed)


def saturate_quals(quals) -> Column:
    """Barcode quality characters, saturated at the highest quality the key keeps."""
    return F.translate(F.substring(_col(quals), 1, BC_LEN), _ABOVE, _SATURATED * len(_ABOVE))


def quals_in_range(quals) -> Column:
    """True when the first 16 quality characters all are '!' or above."""
    return _col(quals).rlike(r"^[!-\x7f]{16}")


def qual_at(quals, index) -> Column:
    """Saturated quality value at a 0-based position."""
    q = F.ascii(F.substring(_col(quals), index + 1, 1)) - F.lit(PHRED_OFFSET)
    return F.least(q, F.lit(MAX_QUAL))


def phred_prob(q) -> Column:
    q = _col(q).cast("double")
    return F.pow(F.lit(10.0), -F.least(q, F.lit(float(MAX_QUAL))) / F.lit(10.0))


def key_bytes(bases, quals) -> Column:
    """Quality-aware key: one value base * 34 + quality per barcode position."""
    digits, quals = base_digits(bases), _col(quals)
    return F.transform(
        F.sequence(F.lit(1), F.lit(BC_LEN)),
        lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.lit(MAX_QUAL + 1)
        + F.least(F.ascii(F.substring(quals, i, F.lit(1))) - F.lit(PHRED_OFFSET), F.lit(MAX_QUAL)),
    )


def key_binary(bases, quals) -> Column:
    """The key as BINARY(16), the layout of the full-count interchange file."""
    hexes = F.transform(key_bytes(bases, quals), lambda b: F.lpad(F.hex(b), 2, "0"))
    return F.unhex(F.array_join(hexes, ""))


def n_count(bases) -> Column:
    bases = _col(bases)
    return F.length(bases) - F.length(F.translate(bases, "N", ""))


def reverse_complement(seq) -> Column:
    return F.reverse(F.translate(_col(seq), "ACGT", "TGCA"))


def unpack_key(key) -> tuple[Column, Column]:
    """(bases, quals) of a BINARY(16) quality-aware key."""
    byte = lambda i: F.conv(F.hex(F.substring(_col(key), i, F.lit(1))), 16, 10).cast("int")
    each = lambda make: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(BC_LEN)), make), "")
    width = MAX_QUAL + 1
    bases = each(lambda i: F.substring(F.lit("ACGTN"), F.floor(byte(i) / width).cast("int") + 1, F.lit(1)))
    return bases, each(lambda i: F.chr(byte(i) % width + PHRED_OFFSET))
