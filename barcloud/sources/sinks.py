"""Text outputs: bucket shards and SAM."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barcloud.config import DEFAULT_POLICY, SkewPolicy
from barcloud.operators.sam import sam_header, sam_line


def write_shards(lines: DataFrame, path: str, load: DataFrame, policy: SkewPolicy = DEFAULT_POLICY) -> None:
    """One directory per bucket (``bucket=0`` holds the pairs without barcode).

    ``load``: (bucket, n), one row per bucket.  Rows are shuffled by bucket so that tasks do not
    write to all buckets, and a heavy bucket is spread over as many tasks as its size asks for, none of which
    has another one of known load; a bucket of unknown load is spread as if it held all rows.
    """
    parts = F.ceil(F.col("n") / policy.target_file_rows).cast("int")
    # one row per bucket: bounded by the bucket count the caller chose
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sized = load.select("bucket", F.greatest(parts, F.lit(1)).alias("_parts"), parts.alias("_full")).select(
        "bucket", "_parts", "_full", F.coalesce(F.sum("_parts").over(before), F.lit(0)).alias("_first"))
    at_least = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = sized.agg(F.sum("_parts").alias("parts"), F.sum("_full").alias("full")).first()
    tasks = max(at_least, total["parts"] or 1)
    spread = lambda n: F.pmod(F.xxhash64("value"), n)
    task = F.coalesce(F.col("_first") + spread(F.col("_parts")), spread(F.lit(max(1, total["full"] or 0)))).cast("int")
    placed = lines.join(F.broadcast(sized), "bucket", "left").withColumn("_task", task)
    placed.repartitionById(tasks, "_task").select("bucket", "value").write.partitionBy("bucket").text(path)


def write_sam(records: DataFrame, contigs: DataFrame, path: str, read_group: str | None = None, command: str = "barcloud") -> None:
    """``path/header`` and ``path/body``: their part files, concatenated in this order, are a SAM file.

    The lines of a pair stay adjacent: rows are placed and sorted by pair before writing.
    """
    sam_header(contigs, read_group, command).coalesce(1).write.text(f"{path}/header")
    placed = records.repartition("bc", "ident").sortWithinPartitions("bc", "ident", "mate")
    placed.select(sam_line(records).alias("value")).write.text(f"{path}/body")
