"""Balanced barcode buckets and routing of reads to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barcloud.config import BC_LEN, DEFAULT_POLICY, MATE1_TRIM, MIN_READ_SIZE, SkewPolicy
from barcloud.functions import bases as B
from barcloud.functions import headers as H
from barcloud.operators.counting import is_usable, with_key
from barcloud.operators.skew import attach_by_key, fits_broadcast

_PREFIX_BITS = 16  # barcodes are 32-bit codes: at most 65536 prefixes of at most 65536 barcodes


def running_total(counts: DataFrame) -> DataFrame:
    """Add ``before``: the sum of n over all smaller barcodes.

    Two bounded levels instead of one global window: sums per 16-bit prefix (at most 65536 rows
    in the only unpartitioned window), then a running sum inside each prefix.
    """
    keyed = counts.withColumn("prefix", F.shiftright("bc", _PREFIX_BITS))
    sums = keyed.groupBy("prefix").agg(F.sum("n").alias("n"))
    ordered = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("prefix", F.coalesce(F.sum("n").over(ordered), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("prefix").orderBy("bc").rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    # 65536 rows at most, whatever the data
    joined = local.join(F.broadcast(offsets), "prefix")
    return joined.select(*counts.columns, (F.col("offset") + F.col("local")).alias("before"))


def assign_buckets(counts: DataFrame, n_buckets: int) -> DataFrame:
    """(bc, n, bucket): buckets 1..n_buckets holding consecutive barcodes.

    A bucket exceeds the mean load by less than its heaviest barcode, the same guarantee a
    smallest-bucket-first greedy assignment gives.
    """
    total = counts.agg(F.greatest(F.sum("n"), F.lit(1))).scalar()
    slot = F.floor(F.col("before") * F.lit(n_buckets) / total).cast("int")
    placed = running_total(counts)
    return placed.select("bc", "n", (F.least(slot, F.lit(n_buckets - 1)) + 1).alias("bucket"))


def _share(counts: DataFrame, policy: SkewPolicy) -> Column:
    """Row count above which a key of a (key, n) table is heavy."""
    part = counts.agg(F.sum("n") / policy.max_heavy_keys).scalar()
    return F.greatest(F.lit(float(policy.max_group_rows)), part)


def _with_bucket(
    rows: DataFrame, buckets: DataFrame, policy: SkewPolicy, broadcast: bool, spread_on: list[str]
) -> DataFrame:
    """Add the bucket of ``bc``; a barcode may hold any share of the rows."""
    if broadcast:
        return rows.join(F.broadcast(buckets.select("bc", "bucket")), "bc", "left")
    dim = buckets.select("bc", "bucket", F.col("n").alias("_reads"))
    heavy = F.col("_reads") > _share(buckets, policy)
    return attach_by_key(rows, dim, ["bc"], heavy, spread_on).drop("_reads")


#: How many barcodes of a whitelist take the room of one row of the replacement map.
_WIDTH = 8


def route_reads(
    reads: DataFrame, buckets: DataFrame, replacements: DataFrame | None = None, double: bool = False,
    policy: SkewPolicy = DEFAULT_POLICY, broadcast: bool | None = None,
) -> DataFrame:
    """Add the final barcode ``bc`` and ``bucket`` (0 = no barcode) to every usable pair.

    Without double edits a whitelisted barcode never changes, so its reads are resolved by the
    whitelist alone, without a shuffle of the reads when it is provably small; only the
    remaining reads are joined with the replacement map.  A map proven small is broadcast, too, and
    then one pass over the reads does all; beyond that, the reads are read twice, so that those of whitelisted barcodes
    (nearly all) aren't shuffled.
    """
    usable = with_key(reads.where(is_usable()))
    raw = F.when(B.n_count("bases") == 0, B.pack("bases"))
    if broadcast is None:
        broadcast = fits_broadcast(buckets.select("bc"), policy)
    columns = [*reads.columns, "bc", F.coalesce("bucket", F.lit(0)).alias("bucket")]
    placed = _with_bucket(usable.withColumn("bc", raw), buckets, policy, broadcast, ["name"])
    unknown = F.when(F.col("bucket").isNotNull(), F.col("bc")).alias("bc")
    if replacements is None:
        return placed.withColumn("bc", unknown).select(*columns)

    # The bucket of a replacement is looked up once per key, not once per read.
    changed = replacements.select("bases", "quals", "n", F.col("assigned").alias("bc"))
    target = _with_bucket(changed, buckets, policy, broadcast, ["quals"]).select(
        "bases", "quals", "n", F.col("bc").alias("assigned"), F.col("bucket").alias("new_bucket"))
    final = {"bc": F.coalesce("assigned", unknown), "bucket": F.coalesce("new_bucket", "bucket")}
    # a row of two strings and two numbers is about eight times as wide as a barcode
    if replacements.count() <= policy.max_broadcast_rows // _WIDTH:
        # without double edits no replacement has the bases of a whitelisted barcode, so its reads stay as they are
        small = F.broadcast(target.drop("n"))
        return placed.join(small, ["bases", "quals"], "left").withColumns(final).select(*columns)
    settled = placed.where(F.col("bucket").isNotNull() & F.lit(not double))
    pending = placed.where(F.col("bucket").isNull() | F.lit(double))
    heavy = F.col("n") > _share(replacements, policy)
    moved = attach_by_key(pending, target, ["bases", "quals"], heavy, ["name"]).withColumns(final)
    return settled.select(*columns).unionByName(moved.select(*columns))


def route_haplotag(
    reads: DataFrame, buckets: DataFrame, policy: SkewPolicy = DEFAULT_POLICY, broadcast: bool | None = None
) -> DataFrame:
    """Header-coded reads: every code of the generated whitelist has a bucket, tags that are no code have none (0).

    Buckets hold consecutive codes, so a code without a count goes where the codes around it are.
    """
    if broadcast is None:
        broadcast = fits_broadcast(buckets.select("bc"), policy)
    long_enough = F.coalesce(F.length("r1") >= MIN_READ_SIZE, F.lit(False))
    coded = reads.where(long_enough & H.bx_tag("name").isNotNull()).withColumn("bc", B.pack_haplotag(H.bx_tag("name")))
    known = coded.withColumn("bc", F.when(B.is_haplotag_code("bc"), F.col("bc")))
    placed = _with_bucket(known, buckets, policy, broadcast, ["name"])
    # one row per bucket, as many as the caller asked for
    starts = buckets.groupBy("bucket").agg(F.min("bc").alias("first")).orderBy("first").collect()
    edges = F.array(*[F.struct(F.lit(r["first"]).alias("first"), F.lit(r["bucket"]).alias("bucket")) for r in starts])
    near = F.lit(1)
    if starts:
        at = F.filter(edges, lambda e: e["first"] <= F.col("bc"))
        near = F.coalesce(F.try_element_at(at, F.lit(-1))["bucket"], F.lit(starts[0]["bucket"]))
    bucket = F.when(F.col("bc").isNull(), 0).otherwise(F.coalesce("bucket", near)).cast("int")
    return placed.select(*reads.columns, "bc", bucket.alias("bucket"))


def trimmed(column: str, haplotag: bool = False) -> Column:
    """Mate 1 without barcode and spacer bases; header-coded platforms are not trimmed."""
    col = F.col(column)
    return col if haplotag else F.substring(col, BC_LEN + MATE1_TRIM + 1, 1 << 30)


def shard_lines(routed: DataFrame, bx_format: bool = False, haplotag: bool = False) -> DataFrame:
    """(bucket, value): the text of every routed pair.

    Bucketed pairs are single-line records (or BX-tagged FASTQ with ``bx_format``), pairs
    without barcode plain interleaved FASTQ.
    """
    code = B.unpack_haplotag("bc") if haplotag else B.unpack("bc")
    r1, q1 = trimmed("r1", haplotag), trimmed("q1", haplotag)
    name1, name2 = H.name_only("name"), H.name_only("name2")
    fastq = lambda n1, n2: F.concat_ws("\n", n1, r1, F.lit("+"), q1, n2, F.col("r2"), F.lit("+"), F.col("q2"))
    if bx_format:
        tag = F.concat(F.lit(" BX:Z:"), code, F.lit("" if haplotag else "-1"))
        record = fastq(F.concat(name1, tag), F.concat(name2, tag))
    else:
        record = F.concat_ws(" ", code, name1, r1, q1, "r2", "q2")
    return routed.select("bucket", F.when(F.col("bucket") > 0, record).otherwise(fastq(name1, name2)).alias("value"))
