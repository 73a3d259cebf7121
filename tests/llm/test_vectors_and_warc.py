"""Nearest neighbours, top-k and revisits: recall or equality with brute force, and the odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barcloud.llm import bitslice, centroids, postings, warc

SF = "/root/testdata/sf0.1"
ODD = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [float("nan"), 1.0]),
       (6, [None, 1.0]), (7, [float("inf"), 0.0]), (8, [0.0, 0.0]), (9, [-1.0, 0.1]), (50, [1.0, 0.0]), (None, [1.0, 1.0]), (100, [1.0, 2.0, 3.0])]


def odd_rows(spark):
    rows = [(i, v, "mine") for i, v in ODD]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def matrix(spark, sf: str):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    return rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(np.float64)


def test_recall_and_scores(spark):
    ids, vectors = matrix(spark, SF)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    at = {k: i for i, k in enumerate(ids)}
    rows = postings.op2_ann_postings(spark, SF).toPandas()
    hits = 0
    for query, own in rows.sort_values("rank").groupby("query_id"):
        scores = unit @ unit[at[query]]
        assert list(own["rank"]) == [1, 2, 3, 4, 5] and query not in set(own["vec_id"])
        assert np.allclose(own["score"], scores[[at[v] for v in own["vec_id"]]], atol=1e-12)
        assert (np.diff(own["score"]) <= 0).all()
        scores[at[query]] = -2
        hits += len(set(own["vec_id"]) & set(ids[np.argsort(-scores)[:5]]))
    assert rows["query_id"].nunique() == (ids % 50 == 0).sum()
    assert hits / len(rows) >= 0.9


def test_small_cells_and_pruning_keep_the_answer(spark, monkeypatch):
    for name, value in (("CELL_VECTORS", 40), ("CELL_QUERIES", 3), ("LIST_ROWS", 20), ("PRUNE", 10.0)):
        monkeypatch.setattr(postings, name, value)
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 6)))] + [(300 + i, [1.0] * 6) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in postings.search(df, F.col("vec_id") % 30 == 0).collect()}
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    unit[300:] = unit[300]
    for q in range(0, 390, 30):
        scores = np.round(unit @ unit[q], 12)
        order = [i for i in np.lexsort([np.arange(390), -scores]) if i != q][:5]
        assert [got[q, r + 1] for r in range(5)] == order


def test_graph_search_finds_the_nearest_centroid():
    rng = np.random.default_rng(1)
    centres = centroids.unit(rng.normal(size=(600, 16)))
    queries = centroids.unit(rng.normal(size=(200, 16)))
    nodes, scores = centroids.graph(centres).search(queries)
    assert (nodes[:, 0] == (queries @ centres.T).argmax(1)).mean() > 0.97
    assert (np.diff(scores, axis=1) <= 0).all()


def test_neighbours_odd_rows(spark):
    df = odd_rows(spark)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in postings.search(df, F.col("vec_id") % 50 == 0, k=3).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 50), (0, 3, 2), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert postings.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("n,d,hi", [(1, 1, 5), (3, 2, 1), (100, 8, 300), (1000, 64, 200), (70, 3, 1 << 24), (65, 4, 0), (3000, 16, 40)])
def test_slices_select_exactly(n, d, hi):
    rng = np.random.default_rng(n)
    for _ in range(5):
        rows, ids = rng.integers(-hi, hi + 1, (n, d)), rng.permutation(n)
        own = bitslice.index(rows)
        for query in (rows[0], rng.integers(-hi - 1, hi + 2, d), np.zeros(d, np.int64)):
            got, scores = bitslice.best(own, ids, query, 6)
            exact = rows @ query
            want = np.lexsort([ids, -exact])[:6]
            assert (got == ids[want]).all() and (scores == exact[want]).all()


def test_slices_narrow_the_rows():
    rows = np.random.default_rng(4).normal(0, 32, (20000, 64)).astype(np.int64)
    assert len(bitslice.candidates(bitslice.index(rows), rows[0], 6)) < 2000


def test_topk_cells_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "BLOCK_ROWS", 3)
    monkeypatch.setattr(bitslice, "CHUNK_QUERIES", 1)
    df = odd_rows(spark)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in bitslice.top(df, F.col("vec_id") % 50 == 0, k=3).collect()]
    assert sorted(got) == [(0, 1, 1, 65536), (0, 2, 50, 65536), (0, 3, 2, 32768), (50, 1, 0, 65536), (50, 2, 1, 65536), (50, 3, 2, 32768)]
    assert bitslice.top(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("size", [70000.0, 3.0e9, 1.0e13])
def test_topk_of_large_components_is_exact(spark, size):
    """Components far beyond 65,536, where sums need more than 64 bits; equal high bits are told apart."""
    rng = np.random.default_rng(3)
    values = [[float(np.floor(v)) for v in size * (1 + rng.random(3))] for _ in range(60)]
    values += [[-size, 0.25, size], [size, size, -size], values[7]]
    df = spark.createDataFrame(list(enumerate(values)), "vec_id long, embedding array<double>")
    whole = [[int(256 * x // 1) for x in v] for v in values]
    want = {(q, r + 1, i, s) for q in (0, 50) for r, (s, i) in enumerate(
        sorted(((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in enumerate(whole) if i != q))[:5])}
    got = {(r["query_id"], r["rank"], r["vec_id"], -int(r["score"])) for r in bitslice.top(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == want


def test_revisits_without_a_response_are_spread(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hot = [(0, "http://a.com/", 0, 200, {}, "d", "s")] + [(i, f"http://b.com/{i}", i, 304, {}, None, None) for i in range(1, 4000)]
        hot += [(i, "http://a.com/", i, 304, {}, None, None) for i in range(4000, 8000)]
        sizes = [len(p) for p in warc.resolve(spark.createDataFrame(hot, RECORD)).rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sum(sizes) == 7999 and max(sizes) <= 2 * sum(sizes) / 16


def test_canonical_urls(spark):
    urls = ["HTTP://www.A.com:80/X/?utm_source=q#f", "https://a.com/X", "http://a.com/X?b=1&ref=z", "https://a.com/X?b=1", " http://a.com", None, "http://a.com?pref=1&utm_id=3&ref=4&q=2&fbclid=", "a.com?ref=1&ref=2"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(warc.canonical_url(F.col("url"))).collect()
    assert [r[0] for r in rows] == ["a.com/X", "a.com/X", "a.com/X?b=1", "a.com/X?b=1", "a.com", None, "a.com?pref=1&q=2", "a.com"]


RECORD = "record_id long, url string, ts long, status int, headers map<string,string>, digest string, state string"


def records(spark):
    full = {"etag": '"1"', "content-length": "9", "x": "old"}
    return spark.createDataFrame([
        (1, "http://a.com/", 10, 200, full, "d1", "s"), (2, "https://www.a.com", 20, 200, {"last-modified": "m"}, "d2", "s"),
        (3, "http://a.com#x", 10, 304, {}, None, None), (4, "http://a.com", 11, 304, {"etag": 'W/"1"', "content-length": "0", "x": "new"}, None, None),
        (5, "http://a.com", 20, 304, {"etag": '"2"'}, None, None), (6, "http://a.com", 30, 304, {"last-modified": "m", "connection": "y", "y": "1"}, None, None),
        (6, "http://a.com", 30, 304, {"last-modified": "m", "connection": "y", "y": "1"}, None, None), (7, None, 5, 304, None, None, None),
        (8, "http://a.com", None, 304, None, None, None), (9, "http://a.com", 40, 404, full, "d9", "s"), (10, "http://a.com", 50, 304, None, None, None),
        (2, "https://www.a.com", 20, 200, {"last-modified": "m"}, "d2", "s"),
    ], RECORD)


def test_revisits_resolve_by_the_rules(spark):
    rows = [(r["record_id"], r["state"], r["refers_to"], r["digest"], r["headers"]) for r in warc.resolve(records(spark)).collect()]
    rows.sort(key=lambda r: r[0])
    assert rows == [
        (3, "orphan", None, None, {}), (4, "resolved", 1, "d1", {"etag": 'W/"1"', "content-length": "9", "x": "new"}),
        (5, "mismatch", None, None, {"etag": '"2"'}), (6, "resolved", 2, "d2", {"last-modified": "m"}), (6, "resolved", 2, "d2", {"last-modified": "m"}),
        (7, "orphan", None, None, {}), (8, "orphan", None, None, {}), (10, "resolved", 2, "d2", {"last-modified": "m"}),
    ]
    assert warc.resolve(records(spark).limit(0)).count() == 0


def test_buckets_do_not_change_the_join(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(f"u{0 if i % 3 else i % 7}", int(t), int(i) if rng.random() < 0.3 else None) for i, t in enumerate(rng.permutation(500))]
    events = spark.createDataFrame(rows, "url string, ts long, response long")
    got = {n: {(r["url"], r["ts"]): r["before"] for r in warc.latest_before(events, n).collect()} for n in (1, 40)}
    want = {}
    for url in {r[0] for r in rows}:
        last = None
        for _, ts, response in sorted((r for r in rows if r[0] == url), key=lambda r: r[1]):
            want[url, ts] = last
            last = last if response is None else response
    assert got[1] == got[40] == want
