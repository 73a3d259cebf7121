"""Line-oriented inputs: whitelists, contig indexes and single-line read records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcloud.config import BC_LEN, HAPLOTAG_SEGMENT_MAX, Platform
from barcloud.functions import bases as B
from barcloud.functions import headers as H
from barcloud.operators.counting import check_whitelist


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """(bc): one barcode per line, first 16 characters, distinct; the all-A barcode fails."""
    lines = spark.read.text(path).where(F.length("value") > 0)
    return check_whitelist(lines.select(B.pack(F.substring("value", 1, BC_LEN)).alias("bc")).distinct())


def haplotag_whitelist(spark: SparkSession, segment_max: int = HAPLOTAG_SEGMENT_MAX) -> DataFrame:
    """The generated whitelist as rows; jobs use ``is_haplotag_code`` instead."""
    n = segment_max
    seg = lambda unit: F.floor(F.col("id") / unit) % n + 1
    return spark.range(n ** 4).select(
        (seg(n ** 3) * (1 << 24) + seg(n ** 2) * (1 << 16) + seg(n) * (1 << 8) + seg(1)).cast("long").alias("bc"))


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(chrom_id, name, length) of a FASTA index, numbered in file order."""
    lines = spark.read.text(path, wholetext=True)  # an index has one line per contig
    rows = lines.select(F.posexplode(F.split(F.rtrim("value"), "\n")).alias("chrom_id", "line"))
    word = lambda k: F.regexp_extract("line", rf"^(\S+)(?:\s+(\d+))?", k)
    return rows.where("length(line) > 0").select("chrom_id", word(1).alias("name"), word(2).try_cast("long").alias("length"))


def encode_contigs(df: DataFrame, contigs: DataFrame, column: str, to: str) -> DataFrame:
    """Replace contig names by codes; exact match, and an unknown name is an error."""
    names = contigs.select(F.col("name").alias(column), F.col("chrom_id").alias(to))
    fail = F.raise_error(F.concat(F.lit("unknown contig "), F.col(column))).cast(contigs.schema["chrom_id"].dataType)
    missing = F.col(to).isNull() & F.col(column).isNotNull()
    return df.join(names, column, "left").withColumn(to, F.when(missing, fail).otherwise(F.col(to))).drop(column)


def read_single_line(spark: SparkSession, path, platform: Platform) -> DataFrame:
    """Single-line records 'barcode name r1 q1 r2 q2' -> bc, ident, r1, q1, r2, q2."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).select(parts.alias("p"))
    return rows.select(
        H.encode(F.col("p")[0], platform).alias("bc"), H.identifier(F.col("p")[1]).alias("ident"),
        *[F.col("p")[k].alias(c) for k, c in enumerate(("r1", "q1", "r2", "q2"), start=2)])


def with_barcodes(pairs: DataFrame, platform: Platform) -> DataFrame:
    """Header-coded pairs -> bc, ident, r1, q1, r2, q2; both mates must carry the same barcode."""
    text, ident = H.split_header("name", platform)
    bc, bc2 = H.encode(text, platform), H.extract_barcode("name2", platform)
    fail = F.raise_error(F.lit("mates with different barcodes")).cast("long")
    return pairs.select(
        F.when(~bc.eqNullSafe(bc2), fail).otherwise(bc).alias("bc"), H.identifier(ident).alias("ident"),
        "r1", "q1", "r2", "q2")
