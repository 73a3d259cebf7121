"""SimHash near-duplicates found with BK-trees of fingerprint shards.

Two fingerprints within ``RADIUS`` = 4 bits agree in at least two of six bit groups.  So every
distinct fingerprint goes to the 15 shards of its group pairs, and any link has both ends in one of
them.  Each shard is one BK-tree: a node's children are keyed by their Hamming distance to it, and a
search follows the edges within the radius.  A shard yields a spanning forest of its links, never
all pairs.  Shards above ``SHARD_ROWS`` are dealt again by the bits not yet fixed; distinct
fingerprints of a shard halve with each fixed bit, so the shards end bounded however many near
copies there are.

The trees stay in the tasks that own the shards and the fingerprints travel to them: the trees of all
documents have no size bound, so they are not broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from barcloud.llm.common import attach_facts, bytes_and_offsets, small_or_shuffled, table, with_arrow_columns
from barcloud.session import cut_lineage, write_table

RADIUS = 4
GROUPS = RADIUS + 2
SHINGLE = 4
SEED = 42
SHARD_ROWS = 4096
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in more than half of the shingle hashes; no word gives zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint ``fp`` as a long (the 64 bits, signed); null text is empty."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, offsets = bytes_and_offsets(batch.column("_bytes"))
        data = memoryview(data)
        found = [fingerprint(bytes(data[a:b]), shingle) for a, b in zip(offsets[:-1], offsets[1:])]
        return {"fp": pa.array(np.array(found, np.uint64).view(np.int64))}

    ready = docs.withColumn("_bytes", F.col(text_col).cast("binary"))
    return with_arrow_columns(ready, make, T.StructType([T.StructField("fp", T.LongType())]), drop=("_bytes",))


class BKTree:
    """Integers by Hamming distance; children are keyed by their distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int, radius: int) -> list[int]:
        """Numbers of the earlier values within ``radius``; ``value`` is then a node too."""
        near, number = [], len(self.values)
        if number:
            waiting, hang = [0], 0
            while waiting:
                at = waiting.pop()
                d = (self.values[at] ^ value).bit_count()
                if d <= radius:
                    near.append(at)
                waiting += [c for edge, c in self.children[at].items() if d - radius <= edge <= d + radius]
            while True:
                d = (self.values[hang] ^ value).bit_count()
                if d not in self.children[hang]:
                    self.children[hang][d] = number
                    break
                hang = self.children[hang][d]
        self.values.append(value)
        self.children.append({})
        return near


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(value, root) for every value of the shard that is linked to another; values are distinct."""
    tree, root = BKTree(), list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):
        for j in tree.add(value, radius):
            root[find(i)] = find(j)
    return [(v, values[find(i)]) for i, v in enumerate(values) if find(i) != i]


def bit_groups(bits: list[int]) -> list[int]:
    """``bits`` dealt to GROUPS masks of nearly equal size."""
    masks = [0] * GROUPS
    for k, bit in enumerate(bits):
        masks[k * GROUPS // len(bits)] |= 1 << bit
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _shards(rows: DataFrame, free: list[int]) -> DataFrame:
    """``rows`` (mask, part, fp) in the shards of each pair of groups of ``free`` bits."""
    pairs = [_signed(a | b) for a, b in combinations(bit_groups(free), 2)]
    more = rows.select("mask", "fp", F.explode(F.array(*[F.lit(p) for p in pairs])).alias("pair"))
    return more.select(F.col("mask").bitwiseOR(F.col("pair")).alias("mask"), "fp").withColumn(
        "part", F.col("fp").bitwiseAND(F.col("mask"))
    )


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp`` that connect all within RADIUS bits, spanning forests of the shards."""
    level = _shards(distinct.select(F.lit(0).cast("long").alias("mask"), "fp"), list(range(64)))
    found = None
    while True:
        # all masks of a level leave the same number of bits free, but not the same bits
        sizes = level.groupBy("mask", "part").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        sizes = write_table(sizes, "simhash-shards")
        shared = level.join(small_or_shuffled(sizes), ["mask", "part"])
        light = _forest(shared.where(F.col("n") <= SHARD_ROWS))
        heavy_masks = [r["mask"] for r in sizes.where(F.col("n") > SHARD_ROWS).select("mask").distinct().collect()]
        free = {m: [b for b in range(64) if not (m >> b) & 1] for m in heavy_masks}
        if free and min(map(len, free.values())) <= 12:  # at most 4096 distinct values are left in a shard
            return _union(found, _forest(shared))
        found = _union(found, light)
        if not free:
            return found
        heavy = shared.where(F.col("n") > SHARD_ROWS)
        parts = [_shards(heavy.where(F.col("mask") == m), bits) for m, bits in free.items()]
        level = parts[0]
        for part in parts[1:]:
            level = level.unionByName(part)
        level = write_table(level.distinct(), "simhash-heavy")


def _union(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def _forest(rows: DataFrame) -> DataFrame:
    """Links of every shard; a shard's rows are consecutive in a task, and may span batches."""
    ready = rows.select("mask", "part", "fp").repartition("mask", "part").sortWithinPartitions("mask", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("mask", "part", "fp")], 1)
            held = np.concatenate([held, rows])
            edges = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(1)) + 1
            if len(edges):
                yield _linked(np.split(held[:, 2], edges)[:-1])
                held = held[edges[-1] :]
        if len(held):
            yield _linked([held[:, 2]])

    def _linked(shards: list[np.ndarray]) -> pa.RecordBatch:
        pairs = [p for s in shards if len(s) > 1 for p in shard_links(s.view(np.uint64).tolist())]
        both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return ready.mapInArrow(run, "a long, b long")


def connect(edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest node each is connected to, by alternating large and small stars.

    Every round is cut by a checkpoint; nodes with many neighbours only meet in aggregates.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node join the smallest of its neighbourhood
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a node and its smaller neighbours join the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = cut_lineage(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def components(printed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``printed`` (id, fp) with ``component_id``, the smallest id of all rows whose fingerprints are connected.

    Rows with a null id belong to their component without naming it; a component of such rows only
    has a null ``component_id``.
    """
    facts = printed.groupBy("fp").agg(F.min(id_col).alias("rep"), F.count("*").alias("n"))
    facts = write_table(facts, "simhash-distinct")
    roots = connect(links(facts.select("fp")))
    placed = facts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.join(placed.groupBy("root").agg(F.min("rep").alias("component_id")), "root")
    named = write_table(named.select("fp", "n", "component_id"), "simhash-components")
    return without_counts(attach_facts(printed, named, ["fp"], "n", [id_col]))


def without_counts(df: DataFrame) -> DataFrame:
    return df.drop("n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row (id, fp, component_id) per row of ``docs``; an empty table gives none."""
    printed = fingerprints(docs.select(F.col(id_col), F.col(text_col)), text_col, shingle).select(id_col, "fp")
    return components(write_table(printed, "simhash-printed"), id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies by the pipeline's rule; see ``nearcopies``."""
    from barcloud.llm import nearcopies  # it builds on this module

    return nearcopies.keep_one(docs, id_col, text_col)


def op10_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
