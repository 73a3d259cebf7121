"""Hand-computed values of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from barcloud.config import get_platform
from barcloud.functions import alignment as A
from barcloud.functions import bases as B
from barcloud.functions import headers as H

P10X = get_platform("10x")


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_packing(spark):
    seq = F.lit("ACGTACGTACGTACGT")
    assert one(spark, B.pack(seq), B.pack_little_endian(seq)) == (454761243, 3840206052)
    assert one(spark, B.unpack(F.lit(454761243)), B.unpack_little_endian(F.lit(3840206052))) == ("ACGTACGTACGTACGT",) * 2
    assert one(spark, B.pack(F.lit("acgtNCGT")), B.pack(F.lit("ACGTACGT"))) == (6939, 6939)


def test_haplotag(spark):
    tag = F.lit("A01C02B03D04")
    code = B.pack_haplotag(tag)
    assert one(spark, code, B.unpack_haplotag(code), B.is_haplotag_code(code)) == (16909060, "A01C02B03D04", True)
    assert one(spark, B.is_haplotag_code(B.pack_haplotag(F.lit("A00C02B03D04")))) == (False,)
    assert one(spark, B.pack_haplotag(F.lit("A1C02B03D04x")), B.pack_haplotag(F.lit("123456789012"))) == (None, None)
    assert one(spark, H.bx_tag(F.lit("@r1 1:N BX:Z:A01C02B03D04 x")), H.bx_tag(F.lit("@r1BX:Z:A01C02B03D04"))) == ("A01C02B03D04", None)


def test_quality_key(spark):
    bases, quals = F.lit("TN" + "A" * 14), F.lit("I#" + "!" * 14)
    key = one(spark, B.key_bytes(bases, quals))[0]
    assert key[:3] == [3 * 34 + 33, 4 * 34 + 2, 0]
    assert one(spark, *B.unpack_key(B.key_binary(bases, quals))) == ("TN" + "A" * 14, "B#" + "!" * 14)
    probs = one(spark, *[B.phred_prob(F.lit(q)) for q in (2, 33, 40)])
    assert probs == pytest.approx((10 ** -0.2, 10 ** -3.3, 10 ** -3.3))
    assert one(spark, B.quals_in_range(F.lit("I" * 16)), B.quals_in_range(F.lit("I" * 15 + " ")), B.quals_in_range(F.lit("I" * 15))) == (True, False, False)


@pytest.mark.parametrize("platform, header, bc, ident", [
    ("10x", "@r1:ACGTACGTACGTACGT", 454761243, "@r1"),
    ("dbs", "@RUN:4:FC:1 BX:Z:CTTGGTCATTCATACAGTCC", "CTTGGTCATTCATACAGTCC", "@RUN:4:FC:1"),
    ("tellseq", "@RUN:1:TTATTTAATCTTAGTCGT 1:N:0:1", "TTATTTAATCTTAGTCGT", "@RUN:1"),
    ("tellseq", "@RUN:1:1 BX:Z:TTATTTAATCTTAGTCGT", "TTATTTAATCTTAGTCGT", "@RUN:1:1"),
    ("tru", "@12345", 12345, "@12345"),
    ("tru", "name", 0, "name"),
    ("cpt", "@name:xx77", 77, "@name"),
    ("haplotag", "@r1 BX:Z:A01C02B03D04", 16909060, "@r1"),
])
def test_headers(spark, platform, header, bc, ident):
    platform = get_platform(platform)
    text, rest = H.split_header(F.lit(header), platform)
    expected = one(spark, B.pack(F.lit(bc)))[0] if isinstance(bc, str) else bc
    assert one(spark, H.encode(text, platform), rest) == (expected, ident)


def test_scores(spark):
    def score(cigar, nm):
        cols = A.score_columns(A.parse_cigar(F.lit(cigar)), F.lit(nm), P10X)
        return one(spark, cols["score"], cols["score_mapq"])

    assert score("100M", 1) == (pytest.approx(-7.006804812), 57)
    assert score("90M10S", 0)[1] == 44
    likelihood, quality = score("50M2I40M3D8S", 6)
    assert likelihood == pytest.approx(89 * math.log(0.999) + math.log(0.001) + 2 * math.log(1e-4) + 8 * math.log(0.03))
    assert quality == int(60 - 3 - 8 + 8 * math.log10(0.03))
    cigar = A.parse_cigar(F.lit("5H50M2I40M3D8S"))
    assert one(spark, A.reference_length(cigar), A.cigar_string(cigar)) == (93, "5S50M2I40M3D8S")


def test_mapq(spark):
    values = one(spark, *[A.gamma_quality(F.lit(g)) for g in (0.5, 0.99, 0.999, 0.999999, 0.9999995, -1.0)])
    assert values == (3, 19, 29, 59, 60, -3)
    assert one(spark, A.final_mapq(F.lit(-1.0), F.lit(60), F.lit(60)), A.final_mapq(F.lit(1.0), F.lit(-2), F.lit(99))) == (0, 0)


def test_pairing(spark):
    at = [-36, -35, 0, 750, 751]
    assert one(spark, *[A.mate_penalty(F.lit(1000 + d), F.lit(1000)) for d in at]) == (-15, 0, 0, 0, -15)
    proper = [A.is_proper_pair(F.lit(1), F.lit(1000), F.lit(False), F.lit(1), F.lit(1000 + d), F.lit(True)) for d in at]
    assert one(spark, *proper) == (False, False, True, True, False)


def test_flags_and_length(spark):
    true, false = F.lit(True), F.lit(False)
    assert one(spark, A.mapped_flag(F.lit(0), false, false, true, true, true),
               A.mapped_flag(F.lit(1), true, false, true, false, true)) == (99, 147)
    assert one(spark, A.mapped_flag(F.lit(0), false, false, false, F.lit(None).cast("boolean"), false),
               A.unmapped_flag(F.lit(0), false)) == (73, 133)
    length = lambda *v: A.template_length(*[F.lit(x) for x in v])
    assert one(spark, length(1, 1000, False, 100, 1, 1300, True, 100), length(1, 1300, True, 100, 1, 1000, False, 100),
               length(1, 1000, False, 100, 2, 1300, True, 100)) == (400, -400, 0)


@pytest.mark.parametrize("value", [0.5, 1.0, 0.123456, 0.0001234567, 1.23456e-7, 0.9999951, 0.99999949, -1.0, 0.0, 12345.6, 1e-300])
def test_general_format(spark, value):
    assert one(spark, A.general_5g(F.lit(value))) == ("%.5g" % value,)


def test_density_and_strand(spark):
    assert one(spark, A.log_density(F.lit(0), P10X), A.log_density(F.lit(4), P10X)) == pytest.approx((math.log(0.6), -5.298317), abs=1e-6)
    assert one(spark, B.reverse_complement(F.lit("AACGTN"))) == ("NACGTT",)
