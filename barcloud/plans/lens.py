"""Deterministic views of the driver's tables in the shapes of reads and candidates.

The SQL runs unchanged in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcloud.config import BC_LEN
from barcloud.functions.bases import unpack

READS_SQL = """
select read_id, tru, kind, epos, q_epos, q_tail,
 case when kind = 'sub' then tru + ((cast(floor(tru / p4) as bigint) % 4 + ex) % 4 - cast(floor(tru / p4) as bigint) % 4) * p4
      when kind = 'none' then (tru + 2147483648 + read_id * 65536) % 4294967296
      else tru end as obs,
 case when kind = 'n1' then 1 when kind = 'n2' then 2 else 0 end as n_cnt, r1_len
from (select o_orderkey as read_id,
  ((cast(floor(o_custkey / 3) as bigint) * 41475 + 771) % 268435456) * 16 + case o_custkey % 3 when 0 then 0 when 1 then 1 else 5 end as tru,
  case o_orderkey % 10 when 0 then 'sub' when 1 then 'n1' when 2 then 'n2' when 3 then 'none' else 'ok' end as kind,
  cast(floor(o_orderkey / 10) as bigint) % 16 as epos, 1 + cast(floor(o_orderkey / 10) as bigint) % 3 as ex,
  cast(power(4, cast(floor(o_orderkey / 10) as bigint) % 16) as bigint) as p4,
  (o_orderkey * 7) % 34 as q_epos, case when o_orderkey % 7 = 0 then 2 else 33 end as q_tail,
  case when o_orderkey % 50 = 4 then 31 else 151 end as r1_len
 from {orders}) z
"""

CANDIDATES_SQL = """
select bc, ident, mate, bwa_rank, chrom, base + case when rev = 1 then off else 0 end as pos, rev, 100 as read_len,
       s_len, i_len, 100 - s_len - i_len as m_len, x + i_len as edit_dist, bwa_mapq
from (select *, 1 + (seed * 7919 + bwa_rank * 104729) % 3000000 as base,
        case when dupgrp = 1 then 0 else (ident + bwa_rank % 2 * (ident % 3)) % 5 end as chrom
  from (select *, cast(floor((rn - 1) / 2) as bigint) as bwa_rank, rn % 2 as mate, (ident + rn) % 2 as rev, rn % 4 as x,
          case when dupgrp = 1 then bc else ident end as seed
    from (select l_orderkey as ident, l_partkey % 61 as bwa_mapq,
            row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as rn,
            case when l_orderkey % 11 = 0 then 1000 + l_orderkey % 509 else l_orderkey % 97 end as bc,
            case when l_orderkey % 13 = 0 then 1 else 0 end as dupgrp,
            case when l_orderkey % 13 = 0 then 200 else l_partkey % 1000 - 100 end as off,
            case when l_suppkey % 7 = 0 then cast(l_quantity as bigint) else 0 end as s_len,
            case when l_suppkey % 5 = 0 then 2 else 0 end as i_len
          from {lineitem}) a) b) c
"""


_INSERT = "ACGTTGCAAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return spark.sql(READS_SQL, orders=table(spark, sf_dir, "orders").where(where))


def fastq_reads(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """read_id, name, r1, q1, name2, r2, q2: the reads lens rendered as FASTQ fields.

    Mate 1 is barcode (N where the lens has one; a second N follows the first towards the left,
    wrapping around), 7 spacer bases and an insert.
    """
    at = (F.lit(BC_LEN) - F.col("epos")).cast("int")
    second = (F.lit(BC_LEN) - (F.col("epos") + 1) % BC_LEN).cast("int")
    n = F.lit("N")
    bases = F.when(F.col("n_cnt") > 0, F.overlay(unpack("obs"), n, at)).otherwise(unpack("obs"))
    bases = F.when(F.col("n_cnt") > 1, F.overlay(bases, n, second)).otherwise(bases)
    char = lambda c: F.chr((F.lit(33) + F.col(c)).cast("int"))
    quals = F.overlay(F.concat(F.lit("B" * 14), F.repeat(char("q_tail"), 2)), char("q_epos"), at)
    name = lambda mate: F.concat(F.lit("@r"), F.col("read_id").cast("string"), F.lit(f" {mate}:N:0:1"))
    cut = lambda text: F.substring(text, 1, F.col("r1_len"))
    fields = F.struct(
        "read_id", name(1).alias("name"),
        cut(F.concat(bases, F.lit("T" * 7 + _INSERT * 13))).alias("r1"),
        cut(F.concat(quals, F.lit("F" * 140))).alias("q1"),
        name(2).alias("name2"), F.lit("G" + _INSERT[::-1] * 5).alias("r2"), F.lit("I" * 51).alias("q2"))
    # a generator keeps filters from re-evaluating the rendering, as if the fields came from a file
    return reads(spark, sf_dir, where).select(F.inline(F.array(fields)))


def whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select(F.col("tru").alias("bc")).distinct()


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates contract, with match / indel lengths in place of a CIGAR array."""
    raw = spark.sql(CANDIDATES_SQL, lineitem=table(spark, sf_dir, "lineitem"))
    indel = F.when(F.col("i_len") > 0, F.concat(F.col("i_len").cast("string"), F.lit("I"))).otherwise(F.lit(""))
    clip = F.when(F.col("s_len") > 0, F.concat(F.col("s_len").cast("string"), F.lit("S"))).otherwise(F.lit(""))
    return raw.select(
        "bc", "ident", F.col("mate").cast("long").alias("mate"), "bwa_rank", "chrom", "pos", (F.col("rev") == 1).alias("rev"), "read_len",
        F.col("s_len").alias("clip"), F.col("m_len").alias("match_len"), F.col("i_len").alias("indel_len"),
        F.when(F.col("i_len") > 0, F.lit(1)).otherwise(F.lit(0)).alias("indel_runs"),
        "edit_dist", "bwa_mapq", F.col("m_len").alias("ref_len"),
        F.concat(F.col("m_len").cast("string"), F.lit("M"), indel, clip).alias("cigar_text"),
    )
