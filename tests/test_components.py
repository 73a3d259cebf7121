"""Components of clouds that share reads against a union-find, with hubs, chains and null nodes."""

import random

from pyspark.sql import functions as F

from barcloud.config import SkewPolicy
from barcloud.operators import components


def rows_of():
    rng = random.Random(1)
    rows = [(bc, read, 0, rng.randrange(60)) for bc in range(3) for read in range(40) for _ in range(rng.randrange(1, 3))]
    rows += [(9, i, 0, n) for i in range(200) for n in (i, i + 1)]  # a chain
    rows += [(10, 0, 1, n) for n in range(150)]  # one read in all clouds
    rows += [(10, 1, 1, 200), (10, 2, 1, None), (None, 3, 0, 5)]
    return rows + rows[:20]


def by_union(rows):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for bc, read, mate, n in rows:
        if n is None:
            continue
        root.setdefault((bc, n), (bc, n))
        a, b = find((bc, n)), find(first.setdefault((bc, read, mate), (bc, n)))
        root[max(a, b)] = min(a, b)
    return {x: find(x)[1] for x in root}


def test_components_equal_union_find(spark):
    rows = [r for r in rows_of() if r[0] is not None]
    links = spark.createDataFrame(rows, "bc long, ident long, mate int, node long")
    want = by_union(rows)
    for policy in (SkewPolicy(), SkewPolicy(max_group_rows=10, max_heavy_keys=100)):
        got = {(r.bc, r.node): r.component for r in components.connected(links, ["bc"], ["ident", "mate"], "node", policy).collect()}
        assert got == want
    assert components.connected(links.limit(0), ["bc"], ["ident", "mate"], "node").count() == 0


def test_shares_of_a_component(spark):
    rows = [(1, 7, 0, 0, 100, 0.5), (1, 7, 0, 2, 50, 0.5), (1, 8, 0, 2, 50, 1.0), (1, 9, 0, 3, 10, 0.0), (2, 7, 0, 0, 100, 1.0)]
    df = spark.createDataFrame(rows, "bc long, ident long, mate int, chrom int, cloud long, gamma double")
    got = {(r.bc, r.chrom): (r.component, r.n_clouds, r.weight, r.share) for r in components.cloud_components(df).collect()}
    assert got == {(1, 0): (100, 2, 0.5, 0.25), (1, 2): (100, 2, 1.5, 0.75), (1, 3): ((3 << 40) + 10, 1, 0.0, None), (2, 0): (100, 1, 1.0, 1.0)}


def test_a_hub_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        edges = spark.range(1, 20_000).select(F.lit(1).cast("long").alias("bc"), F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
        both = edges.unionByName(edges.select("bc", F.col("v").alias("u"), F.col("u").alias("v")))
        held = components._least_attached(both, ["bc"], SkewPolicy(max_group_rows=1000, max_heavy_keys=100))
        sizes = [r["count"] for r in held.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 2 * 19_999 and max(sizes) <= 2 * sum(sizes) / 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
