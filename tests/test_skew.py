"""Partition sizes of the skew-safe join, measured on the shuffled rows themselves."""

import pytest
from pyspark.sql import functions as F

from barcloud.operators.skew import attach_by_key


@pytest.fixture()
def no_auto_broadcast(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for key, value in zip(kept, ("-1", "false")):
        spark.conf.set(key, value)
    yield spark
    for key, value in kept.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("hot", [7, None])
def test_a_key_with_three_quarters_of_the_rows_is_spread(no_auto_broadcast, hot):
    spark = no_auto_broadcast
    rows = spark.range(200_000).select("id", F.when(F.col("id") % 4 != 0, F.lit(hot).cast("long")).otherwise(F.col("id") + 10).alias("bc"))
    facts = rows.groupBy("bc").agg(F.count("*").alias("n"))
    joined = attach_by_key(rows, facts, ["bc"], F.col("n") > 10_000, ["id"])
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 200_000
    assert max(sizes) <= 2 * 200_000 / 8
    wrong = joined.where(
        ~F.col("n").eqNullSafe(F.when(F.col("bc") == 7, 150_000).when(F.col("bc").isNotNull(), 1))
    )
    assert wrong.count() == 0


def test_written_tables_can_be_removed(spark):
    import os

    from barcloud import session

    df = session.write_table(spark.range(3), "probe")
    path = df.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert os.path.exists(path) and df.count() == 3
    session.remove_tables(spark)
    assert not os.path.exists(path)


def test_a_broadcast_is_bounded_by_the_drivers_heap(spark, monkeypatch):
    from barcloud.config import SkewPolicy
    from barcloud.operators import skew

    assert skew.broadcast_limit(SkewPolicy(), 1 << 40) == SkewPolicy().max_broadcast_rows
    assert skew.broadcast_limit(SkewPolicy(), 750 << 20) < 3_600_000  # the barcodes of 6 GB on a driver of 1.5 GB
    assert skew.fits_broadcast(spark.range(100), SkewPolicy(max_broadcast_rows=100))
    monkeypatch.setattr(skew, "_ROW_BYTES", 1 << 40)
    assert not skew.fits_broadcast(spark.range(100), SkewPolicy(max_broadcast_rows=100))


def test_correction_builds_two_tables_of_the_whitelist_at_most(spark):
    from barcloud.operators import correction

    keys = spark.createDataFrame([("ACGTACGTACGTACGA", "I" * 16, 1), ("ACGTACGTACGTACGT", "I" * 16, 2)], "bases string, quals string, n long")
    priors = spark.range(1, 1000).select(F.col("id").alias("bc"), F.lit(0.001).alias("prior")).localCheckpoint()
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hits = correction._neighbour_hits(correction.observed_bases(keys), priors, True)
        plan = hits._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert sum("BroadcastExchange" in line and "Reused" not in line for line in plan.splitlines()) <= 2
    found = sorted((r.bases[-1], r.cand, r.i, r.j) for r in hits.collect())
    assert found == []  # no barcode of the keys is near the list


def test_correction_tries_each_kind_of_edit(spark):
    from barcloud.operators import correction

    text = {"known": "A" * 15 + "C", "other": "A" * 14 + "GT", "n": "A" * 14 + "NC", "unknown": "A" * 13 + "CAC"}
    keys = spark.createDataFrame([(b, "I" * 16, 1) for b in text.values()], "bases string, quals string, n long")
    priors = spark.createDataFrame([(1, 0.5), (3, 0.25), (11, 0.125), (13, 0.125), (None, 0.5)], "bc long, prior double")
    hits = lambda double: {(r.bases, r.cand, r.i, r.j, r.prior)
                           for r in correction._neighbour_hits(correction.observed_bases(keys), priors, double).collect()}
    single = {(text["known"], 1, -1, -1, 0.5), (text["other"], 11, -1, -1, 0.125), (text["n"], 1, 14, -1, 0.5), (text["n"], 13, 14, -1, 0.125),
              (text["unknown"], 1, 13, -1, 0.5)}
    assert hits(False) == single
    assert hits(True) == single | {
        (text["known"], 11, 14, 15, 0.125), (text["other"], 1, 14, 15, 0.5), (text["other"], 13, 14, 15, 0.125)}


def test_candidates_without_a_barcode_are_an_error(spark):
    from barcloud.plans import align

    df = spark.createDataFrame([(None, 1)], "bc long, ident long")
    with pytest.raises(ValueError, match="no barcode"):
        align.plan_layouts(df)
