"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted to at most ``FIT_ROWS`` vectors (a hash picks them; the bound of the fit) and
linked to a graph that every task searches in memory.  *Every* distinct vector is posted: to its nearest
list, and near a boundary to further ones within ``BOUNDARY`` times that distance, unless a list
already chosen is closer to them than the vector.  A query reads the lists within ``PRUNE`` times the distance of its nearest
centroid.  Lists are joined with queries by number; long lists and lists of many queries are cut into
cells of bounded size, and each cell returns a query's best few, so nothing meets in one task.

Equal vectors are one entry: it keeps the ids that can still be among the nearest of any query, ``k + 1``
smallest ones, for any other copy would come after them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barcloud.llm import centroids
from barcloud.llm.common import attach_facts, table
from barcloud.session import write_table

FIT_ROWS = 65_536
#: Vectors per list that the number of lists aims at, up to MAX_LISTS.
LIST_ROWS = 128
MAX_LISTS = 4_096
REPLICAS = 2
BOUNDARY = 1.1
PRUNE = 1.27
ASSIGN_BEAM = 24
QUERY_BEAM = 192
#: Most vectors and queries of one cell.
CELL_VECTORS = 8_192
CELL_QUERIES = 1_024


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten(), np.float64).reshape(len(values), -1)


def entries(vectors: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """One row per distinct usable vector: entry (its smallest id), dim, vector (doubles) and its ``k + 1`` smallest ids.

    Rows without an id take no part; equal rows count once.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    ).withColumn("h", F.xxhash64("vector")).groupBy("h", "vector", "id").agg(F.lit(1).alias("one"))
    # the rank limit applies before the shuffle too, so a vector of many copies sends few rows
    rank = F.row_number().over(Window.partitionBy("h", "vector").orderBy("id"))
    few = rows.withColumn("r", rank).where(F.col("r") <= k + 1)
    return few.groupBy("h", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.col("ids")[0].alias("entry"), F.size("vector").alias("dim"), "vector", "ids"
    )


def fit(found: DataFrame, total: int, fit_rows: int = FIT_ROWS) -> centroids.Graph:
    """The graph over the centroids of entries of one dimension."""
    share = min(1.0, fit_rows / max(1, total))
    picked = found.where(F.pmod(F.xxhash64("entry"), F.lit(1 << 30)) <= share * (1 << 30))
    rows = picked.select("entry", "vector").limit(2 * fit_rows).toPandas().sort_values("entry")
    sample = centroids.unit(np.stack(rows["vector"].to_numpy()).astype(np.float64))
    lists = max(1, min(MAX_LISTS, math.ceil(total / LIST_ROWS), len(sample)))
    return centroids.graph(centroids.fit(sample, lists))


def _distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosines))


def _posted(found: DataFrame, graph: centroids.Graph, queries: bool) -> DataFrame:
    """``found`` with one row per list to be posted to, or read."""
    shared = found.sparkSession.sparkContext.broadcast(graph)
    schema = T.StructType([*found.schema, T.StructField("list", T.IntegerType())])

    def choose(batches):
        g = shared.value
        between = _distance((g.centres @ g.centres.T)) if not queries else None
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                unit = centroids.unit(_matrix(part.column("vector")))
                nodes, cosines = g.search(unit, QUERY_BEAM if queries else ASSIGN_BEAM)
                far = _distance(cosines)
                if queries:
                    taken = far <= far[:, :1] * PRUNE
                else:
                    nodes, far = nodes[:, :REPLICAS], far[:, :REPLICAS]
                    taken = far <= far[:, :1] * BOUNDARY
                    for j in range(1, nodes.shape[1]):
                        for i in range(j):
                            taken[:, j] &= ~taken[:, i] | (between[nodes[:, i], nodes[:, j]] >= far[:, j])
                row, column = np.nonzero(taken & (nodes >= 0))
                rows = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(nodes[row, column].astype(np.int32))], [*rows.schema.names, "list"]
                )

    return found.mapInArrow(choose, schema)


def _cells(posted: DataFrame, read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides keyed by (list, part, chunk): a list's vectors in parts, its queries in chunks, each pair a cell."""
    def cut(df: DataFrame, most: int, name: str) -> DataFrame:  # one row per list
        return df.groupBy("list").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias(name))

    sizes = F.broadcast(cut(posted, CELL_VECTORS, "parts").join(cut(read, CELL_QUERIES, "chunks"), "list"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("entry"), F.col(n)).cast("int")
    left = posted.join(sizes, "list").withColumn("part", own("parts")).withColumn("chunk", numbers("chunks"))
    right = read.join(sizes, "list").withColumn("chunk", own("chunks")).withColumn("part", numbers("parts"))
    return left.drop("parts", "chunks"), right.drop("parts", "chunks")


def neighbours(found: DataFrame, wanted: DataFrame, k: int, total: int) -> DataFrame:
    """Per entry in ``wanted`` (one dimension): query and its ``k + 1`` best entries (entry, score, ids), itself included."""
    graph = fit(found, total)
    posted, read = _cells(
        write_table(_posted(found.select("entry", "vector", "ids"), graph, False), "ann-lists"),
        write_table(_posted(wanted.select("entry", "vector"), graph, True), "ann-reads"),
    )
    key = ["list", "part", "chunk"]

    def best(key, vectors, queries):
        names = ["query", "entry", "score", "ids"]
        if not len(vectors) or not len(queries):
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())))})
        own = vectors.column("entry").to_numpy()
        scores = centroids.unit(_matrix(queries.column("vector"))) @ centroids.unit(_matrix(vectors.column("vector"))).T
        few = min(k + 1, len(own))
        order = np.argsort(own)
        # of equal scores the smaller entries: a stable sort of columns in order of entry, where a partition finds ties
        ranked = scores[:, order]
        least = np.partition(ranked, -few, axis=1)[:, -few, None]
        row, column = np.nonzero(ranked >= least)
        sort = np.lexsort([column, -ranked[row, column], row])
        row, column = row[sort], column[sort]
        first = np.searchsorted(row, np.arange(len(scores)))
        keep = np.arange(len(row)) - first[row] < few
        row, column = row[keep], column[keep]
        at = pa.array(order[column])
        return pa.table({
            "query": queries.column("entry").take(pa.array(row)), "entry": vectors.column("entry").take(at),
            "score": pa.array(ranked[row, column]), "ids": vectors.column("ids").take(at),
        })

    pairs = posted.groupBy(*key).cogroup(read.groupBy(*key)).applyInArrow(
        best, "query long, entry long, score double, ids array<long>"
    )
    # an entry posted to several lists may be found several times
    once = pairs.groupBy("query", "entry").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))
    return once.withColumn("r", rank).where(F.col("r") <= k + 1).drop("r")


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """The ``k`` nearest found of each row for which ``is_query`` holds: query_id, rank, vec_id, score (cosine).

    Candidates are the other rows of the query's dimension; all of them if fewer.  Rows without an id or
    whose vector is null, empty, zero or has a null or non-finite component take no part; equal rows
    count once; an empty table gives no row.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    found = write_table(entries(vectors, id_col, vector_col, k), "ann-entries")
    asked = vectors.where(is_query & F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("vector")
    ).distinct()
    asked = write_table(asked.join(found.select("vector", F.col("entry").alias("query")), "vector").select("query_id", "query"), "ann-queries")
    dims = found.groupBy("dim").count().collect()  # one row per dimension in use
    parts = []
    for row in dims:
        own = found.where(F.col("dim") == row["dim"])
        wanted = own.join(asked.select(F.col("query").alias("entry")).distinct(), "entry", "left_semi")
        parts.append(neighbours(own, wanted, k, row["count"]))
    if not parts:
        return vectors.sparkSession.createDataFrame([], schema)
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    near = pairs.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    sizes = asked.groupBy("query").agg(F.count("*").alias("n"))
    facts = write_table(near.join(sizes, "query"), "ann-near")
    answered = attach_facts(asked, facts, ["query"], "n", ["query_id"]).where(F.col("near").isNotNull())
    every = F.flatten(F.transform("near", lambda e: F.transform(e["ids"], lambda i: F.struct((-e["score"]).alias("s"), i.alias("id")))))
    others = F.filter(every, lambda e: e["id"] != F.col("query_id"))
    ranked = answered.select("query_id", F.posexplode(F.slice(F.array_sort(others), 1, k)).alias("rank", "hit"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def op2_ann_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
