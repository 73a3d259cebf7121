"""Repeated lines across documents, returned as compressed keep bitmaps instead of text.

A line's key is the line without white space at both ends and with A-Z in lower case.  Keys of ``least`` code
points or more keep their lines in the smallest document id that holds them and lose all others; a missing
id comes after all ids, and rows of one id are one document.  Shorter keys are never touched.

Each document sends one row per distinct key: the key's 128-bit hash, the document and the line numbers.
The rows are range partitioned by (hash, document) and sorted within, so a key may lie in many partitions and none of them
holds a hot one.  A pass over a partition sees each key's first document and marks the lines of every
later one.  Only the first key of a partition may have begun before it: its first document stays open, and is settled by
the last key of the other partitions, one row each.  Texts never take part; they meet the bitmaps at the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barcloud.llm.common import attach_facts, table, with_arrow_columns, without
from barcloud.session import write_table

LEAST = 10
_SPACE = b" \t\n\x0b\x0c\r"


def _row_key(id_col: str, text_col: str) -> list:
    """128 bits that name a row by its id and text; equal rows share them and the result."""
    values = [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")]
    return [F.xxhash64(*values).alias("_k1"), F.xxhash64(F.lit(7), *values).alias("_k2")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode()) >= least)


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per row of ``docs`` and distinct key of at least ``least`` code points, with its line numbers."""
    wanted = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text"),
                         *_row_key(id_col, text_col)).where("_text IS NOT NULL")
    kind = wanted.schema["_id"].dataType.simpleString()
    schema = f"_h1 long, _h2 long, _id {kind}, _k1 long, _k2 long, _n int, _salt int, _lines array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, rows, sizes, places = [], [], [], []
            for row, text in enumerate(batch.column("_text")):
                lines = text.as_py().lower().split(b"\n")  # bytes: only A-Z change
                held: dict[bytes, list[int]] = {}
                for at, line in enumerate(lines):
                    key = line.strip(_SPACE)
                    if len(key) >= least and _long_enough(key, least):
                        held.setdefault(key, []).append(at)
                digests += map(xxhash.xxh3_128_digest, held)
                places += held.values()
                rows += [row] * len(held)
                sizes += [len(lines)] * len(held)
            hashes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), *(batch.column(c).take(take) for c in ("_id", "_k1", "_k2")),
                 pa.array(sizes, pa.int32()), pa.array(np.arange(len(rows)) % 1000, pa.int32()), pa.array(places, pa.list_(pa.int32()))],
                ["_h1", "_h2", "_id", "_k1", "_k2", "_n", "_salt", "_lines"],
            )

    return wanted.mapInArrow(run, schema)


class _Run:
    """The key a pass over a partition is in, and its first document there."""

    def __init__(self):
        self.key, self.first, self.number = None, None, -1


def _marks(batch: pa.RecordBatch, run: _Run) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a sorted batch whose document isn't the first of its key, and rows of the partition's first key's first document."""
    ids = np.empty(len(batch) + 1, object)
    ids[1:] = batch.column("_id").to_pylist()
    hashes = np.stack([batch.column("_h1").to_numpy(), batch.column("_h2").to_numpy()], 1)
    new = np.ones(len(batch), bool)
    new[1:] = (hashes[1:] != hashes[:-1]).any(1)
    new[0] = run.key is None or tuple(hashes[0]) != run.key
    # place 0 stands for the key carried over from the batch before
    start = np.maximum.accumulate(np.where(new, np.arange(1, len(batch) + 1), 0))
    ids[0] = run.first
    later = ids[1:] != ids[start]
    number = run.number + np.cumsum(new)
    run.key, run.first, run.number = tuple(hashes[-1]), ids[start[-1]], int(number[-1])
    return later, (number == 0) & ~later


def decide(keys: DataFrame) -> DataFrame:
    """Rows of lines to drop (``drop``), open rows (``open``) and every partition's last key with its first document (``edge``)."""
    order = [F.col("_h1"), F.col("_h2"), F.col("_id").asc_nulls_last(), F.col("_salt")]
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = [f.name for f in keys.schema if f.name != "_salt"]
    schema = T.StructType([T.StructField("_kind", T.StringType()), *[keys.schema[c] for c in kept]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = _Run(), None
        for batch in batches:
            if not len(batch):
                continue
            later, opened = _marks(batch, state)
            last = batch.select(kept).slice(len(batch) - 1)
            for kind, rows in (("drop", later), ("open", opened)):
                part = batch.select(kept).filter(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(part), pa.string()), *part.columns], ["_kind", *kept])
        if last is not None:
            first = pa.array([state.first], last.column("_id").type)
            columns = [first if c == "_id" else last.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([pa.array(["edge"], pa.string()), *columns], ["_kind", *kept])

    return ranged.mapInArrow(run, schema)


def _pack(n_lines: int, dropped: list[list[int]]) -> tuple[bytes, int]:
    keep = np.ones(n_lines, np.uint8)
    for lines in dropped:
        keep[lines] = 0
    return zlib.compress(np.packbits(keep).tobytes()), n_lines - int(keep.sum())


def keep_mask(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Which of ``n_lines`` lines a bitmap keeps; no bitmap keeps all."""
    if bitmap is None:
        return np.ones(n_lines, bool)
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """A row per text that loses lines: its 128-bit name (``_k1``, ``_k2``), how many rows have it, lines, lines lost, bitmap.

    A bitmap has one bit per line, set where the line stays, compressed by zlib.  Rows with equal id and text share
    one.  Null and empty texts have no key and so no bitmap; an empty table gives no row; other columns are not read.
    """
    decided = write_table(decide(write_table(line_keys(docs, id_col, text_col, least), "line-keys")), "line-marks")
    # one row per partition of the range partitioning, so at most as many keys as partitions
    edges = decided.where("_kind = 'edge'").groupBy("_h1", "_h2").agg(F.min("_id").alias("_least"))
    opened = decided.where("_kind = 'open'").join(F.broadcast(edges), ["_h1", "_h2"])
    earlier = F.col("_least").isNotNull() & (F.col("_id").isNull() | (F.col("_least") < F.col("_id")))
    columns = ["_k1", "_k2", "_n", "_lines"]
    drops = decided.where("_kind = 'drop'").select(columns).unionByName(opened.where(earlier).select(columns))
    texts = drops.groupBy("_k1", "_k2").agg(
        F.first("_n").alias("_n"), F.collect_set("_lines").alias("_dropped"), F.count("*").alias("_copies")
    )
    new = T.StructType([T.StructField("bitmap", T.BinaryType()), T.StructField("n_dropped", T.LongType())])

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        packed = [_pack(n.as_py(), d.as_py()) for n, d in zip(batch.column("_n"), batch.column("_dropped"))]
        return {"bitmap": pa.array([p for p, _ in packed], pa.binary()), "n_dropped": pa.array([n for _, n in packed], pa.int64())}

    # each copy of a row sends the same line lists, so the copies are the rows by distinct list
    texts = texts.withColumn("copies", (F.col("_copies") / F.size("_dropped")).cast("long"))
    return with_arrow_columns(texts.select("_k1", "_k2", "copies", F.col("_n").cast("long").alias("n_lines"), "_n", "_dropped"),
                              make, new, drop=("_n", "_dropped"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with the lines that stay as text, plus ``n_lines`` (before) and ``n_dropped``; all rows and other columns stay.

    A null text stays null and counts as one empty line.  Input columns named like a result give way to it.
    """
    columns = without(docs, "n_lines", "n_dropped").columns
    facts = write_table(keep_bitmaps(docs, id_col, text_col, least), "line-bitmaps").drop("n_lines")
    # the caller's columns travel in a struct, so that their names can't clash
    rest = F.struct(*[F.col(f"`{c}`") for c in columns if c != text_col]).alias("rest")
    rows = docs.select(rest, F.col(f"`{text_col}`").alias("body"), *_row_key(id_col, text_col), F.monotonically_increasing_id().alias("at"))
    joined = attach_facts(rows, facts, ["_k1", "_k2"], "copies", ["at"])
    lines = F.coalesce(F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit(""))) + 1, F.lit(1))
    joined = joined.select("rest", "body", "bitmap", lines.cast("long").alias("n_lines"),
                           F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
    new = T.StructType([T.StructField("body", T.StringType())])

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = batch.column("body")
        marked = np.flatnonzero(batch.column("bitmap").is_valid().to_numpy(zero_copy_only=False))
        if not len(marked):
            return {"body": texts}
        out = texts.to_pylist()
        for i in marked:
            lines = out[i].split("\n")
            keep = keep_mask(batch.column("bitmap")[i].as_py(), len(lines))
            out[i] = "\n".join(line for line, k in zip(lines, keep) if k)
        return {"body": pa.array(out, texts.type)}

    made = with_arrow_columns(joined, make, new, drop=("bitmap",))
    back = [F.col("body").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in columns]
    return made.select(*back, "n_lines", "n_dropped")


def op11_lines_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document before dropping, lines dropped, and the digest of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.*, first_doc IS NOT NULL AND first_doc <> doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
