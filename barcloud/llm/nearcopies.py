"""Near copies by the Jaccard similarity of word shingles: the rule of the pipeline's stage.

Two texts are linked if their sets of five-word shingles have a similarity of ``SIMILARITY`` or more; of every
connected component one document stays.

*Candidates.* Each distinct set goes to ``BANDS`` shards, one for each of as many minimum hashes; sets of similarity
j miss each other in all of them with probability ``(1 - j) ** BANDS``, 2.6e-6 at 0.8.  A shard is a BK-tree of
256-bit SimHashes, which differ by about 39 bits at 0.8 (standard deviation 6) and by 128 where nothing is
shared; pairs within ``RADIUS`` are candidates.  Shards above ``SHARD_ROWS`` are dealt again by further
minimum hashes.

*Confirmation.* The shards give spanning forests, whose components hold every candidate pair.  The sets of a component
meet in one task, one set in it once, and are linked by their exact similarity; only sets that share a rare shingle are
compared, and pairs already connected need no test.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from barcloud.llm.common import attach_facts, bytes_and_offsets, fresh, small_or_shuffled, with_arrow_columns
from barcloud.llm.simhash import CHUNK, SEED, connect, shard_links, without_counts
from barcloud.llm.tokens import Memory
from barcloud.session import write_table

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 8
#: A heavy shard is dealt again LEVELS - 1 times.
LEVELS = 3
LANES = 4
RADIUS = 80
SHARD_ROWS = 4096

_ODD = np.array([xxh64_intdigest(bytes([i]), SEED) | 1 for i in range(64)], np.uint64)
_words = Memory(lambda w: xxh64_intdigest(w, SEED))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one, a text without a word has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    joined = np.full(n, k, np.uint64)
    for i in range(k):
        joined = _mixed(joined * _ODD[0] + hashes[i : i + n])
    return np.unique(joined)


def sketch(found: np.ndarray) -> tuple[bytes, bytes]:
    """SimHash of LANES x 64 bits, and the minimum hashes, of a set of shingles."""
    ones, least = np.zeros(64 * LANES, np.int64), np.full(BANDS * LEVELS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CHUNK):
        part = found[at : at + CHUNK]
        for lane in range(LANES):
            bits = np.unpackbits(_mixed(part * _ODD[lane + 1]).astype("<u8").view(np.uint8)).reshape(-1, 64)
            ones[64 * lane : 64 * lane + 64] += bits.sum(0, dtype=np.int64)
        for i in range(len(least)):
            least[i] = min(least[i], _mixed(part * _ODD[i + 1 + LANES] + _ODD[i]).min())
    return np.packbits(ones * 2 > len(found)).tobytes(), least.astype("<u8").tobytes()


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs`` (with ``_bytes``) with ``set_key`` (0 for no shingle), ``sim`` and ``mins``."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, offsets = bytes_and_offsets(batch.column("_bytes"))
        data, keys, sims, mins = memoryview(data), [], [], []
        for a, b in zip(offsets[:-1], offsets[1:]):
            found = shingles(bytes(data[a:b]), shingle)
            keys.append(xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0)
            sim, least = sketch(found)
            sims.append(sim)
            mins.append(np.frombuffer(least, np.int64))
        return {
            "set_key": pa.array(np.array(keys, np.uint64).view(np.int64)), "sim": pa.array(sims, pa.binary()),
            "mins": pa.array(mins, pa.list_(pa.int64())),
        }

    fields = [("set_key", T.LongType()), ("sim", T.BinaryType()), ("mins", T.ArrayType(T.LongType()))]
    return with_arrow_columns(docs, make, T.StructType([T.StructField(*f) for f in fields]), drop=("_bytes",))


def _shards(rows: DataFrame, level: int) -> DataFrame:
    """``rows`` (part, set_key, sim, mins) in the shards of the minimum hashes of ``level``."""
    own = F.slice("mins", BANDS * level + 1, BANDS)
    more = rows.select("part", "set_key", "sim", "mins", F.posexplode(own).alias("band", "least"))
    return more.select(F.xxhash64("part", "band", "least").alias("part"), "set_key", "sim", "mins")


def _forest(rows: DataFrame) -> DataFrame:
    """Links (a, b) of the sets of every shard, a spanning forest of those within RADIUS."""
    ready = rows.select("part", "set_key", "sim").repartition("part").sortWithinPartitions("part", "set_key")

    def link(held: list[tuple[int, bytes]]) -> Iterator[tuple[int, int]]:
        first: dict[int, int] = {}
        for key, sim in held:
            value = int.from_bytes(sim, "little")
            if first.setdefault(value, key) != key:
                yield key, first[value]
        for a, b in shard_links(list(first), RADIUS):
            yield first[a], first[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "part", ("set_key", "sim")):
            if len(rows) > 1:
                a, b = zip(*found) if (found := list(link(rows))) else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return ready.mapInArrow(run, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], key: str, columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """Consecutive rows of equal ``key``, which may span batches."""
    now, held = None, []
    for batch in batches:
        for k, *row in zip(*(batch.column(c).to_pylist() for c in (key, *columns))):
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(tuple(row))
    if held:
        yield now, held


def candidates(distinct: DataFrame) -> DataFrame:
    """Links (a, b) of distinct sets (set_key, sim, mins) that connect all candidate pairs."""
    level, found = distinct.select(F.lit(0).cast("long").alias("part"), "set_key", "sim", "mins"), None
    for at in range(LEVELS):
        level = write_table(_shards(level, at), "nearcopies-shards")
        sizes = level.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        sizes = write_table(sizes, "nearcopies-sizes")
        shared = level.join(small_or_shuffled(sizes), "part")
        heavy = at < LEVELS - 1 and sizes.where(F.col("n") > SHARD_ROWS).limit(1).count() > 0
        links = _forest(shared.where(F.col("n") <= SHARD_ROWS) if heavy else shared)
        found = links if found is None else found.unionByName(links)
        if not heavy:
            break
        level = shared.where(F.col("n") > SHARD_ROWS).drop("n")
    return found


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sets, sorted and distinct, have that Jaccard similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def linked(sets: list[np.ndarray], least: float = SIMILARITY) -> list[int]:
    """The first set each set is connected with, by exact similarities.

    Similar sets share a shingle among the first ``n - ceil(least * n) + 1`` of their n when all are ordered alike, here the
    rare ones first; only sets that do are compared, and of those none that is connected already.
    """
    if not sets:
        return []
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ranks = np.split(rank[place], np.cumsum([len(s) for s in sets])[:-1])
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders: dict[int, dict[int, list[int]]] = {}  # by shingle: the sets that have it, by component
    for i, own in enumerate(sets):
        first = np.sort(ranks[i])[: len(own) - math.ceil(least * len(own) - 1e-9) + 1]
        tested = set()
        for shingle in first.tolist():
            parts = holders.setdefault(shingle, {})
            for part in list(parts):
                if find(part) == find(i):
                    continue
                near = (j for j in reversed(parts[part]) if j not in tested)
                for j in near:
                    tested.add(j)
                    if similar(own, sets[j], least):
                        a, b = sorted((find(i), find(j)))
                        root[b] = a
                        break
            mine = find(i)
            for part in [p for p in parts if p != mine and find(p) == mine]:
                moved, kept = parts.pop(part), parts.get(mine, [])
                small, large = sorted((moved, kept), key=len)
                large.extend(small)
                parts[mine] = large
            parts.setdefault(mine, []).append(i)
    return [find(i) for i in range(len(sets))]


def _confirmed(docs: DataFrame, text_col: str, shingle: int, coarse: DataFrame) -> DataFrame:
    """(set_key, root) of the sets in ``coarse`` (set_key, text_key, part), by exact similarity within its parts."""
    texts = docs.select(_text_key(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("_bytes"))
    texts = texts.join(small_or_shuffled(coarse), "text_key").groupBy("part", "set_key").agg(F.min("_bytes").alias("_bytes"))

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"_set": pa.array([shingles(v.as_py() or b"", shingle).tobytes() for v in batch.column("_bytes")], pa.binary())}

    sets = with_arrow_columns(texts, make, T.StructType([T.StructField("_set", T.BinaryType())]), drop=("_bytes",))
    sets = sets.repartition("part").sortWithinPartitions("part", "set_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "part", ("set_key", "_set")):
            keys = [k for k, _ in rows]
            root = linked([np.frombuffer(s, np.uint64) for _, s in rows])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([keys[r] for r in root], pa.int64())], ["set_key", "root"])

    return sets.mapInArrow(run, "set_key long, root long")


def _placed(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, text_key, set_key, root, component_id) of every row; ``root`` is a set of the component."""
    ready = docs.select(id_col, _text_key(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("_bytes"))
    printed = write_table(_sketched(ready, shingle), "nearcopies-printed")
    facts = printed.groupBy("set_key").agg(
        F.min(id_col).alias("rep"), F.count("*").alias("n"), F.min("text_key").alias("text_key"),
        F.min("sim").alias("sim"), F.min("mins").alias("mins"),
    )
    facts = write_table(facts, "nearcopies-distinct")
    parts = connect(candidates(facts.where("set_key <> 0"))).withColumnRenamed("root", "part")
    parts = parts.unionByName(parts.select(F.col("part").alias("node"), "part").distinct())
    coarse = parts.withColumnRenamed("node", "set_key").join(facts.select("set_key", "text_key"), "set_key")
    roots = write_table(_confirmed(docs, text_col, shingle, write_table(coarse, "nearcopies-coarse")), "nearcopies-roots")
    placed = write_table(facts.select("set_key", "rep", "n").join(roots, "set_key", "left").withColumn("root", F.coalesce("root", "set_key")), "nearcopies-placed")
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("sets"))
    named = attach_facts(placed, least, ["root"], "sets", ["set_key"]).select("set_key", "n", "root", "component_id")
    named = write_table(named, "nearcopies-components")
    return without_counts(attach_facts(printed.select(id_col, "text_key", "set_key"), named, ["set_key"], "n", [id_col, "text_key"]))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row (id, set_key, component_id) per row of ``docs``; ``component_id`` is the smallest id of the component, null if it has none.

    A null text is an empty one, and texts without a word are copies of each other; an empty table gives no row.
    """
    return _placed(docs, id_col, text_col, shingle).select(id_col, "set_key", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: of the smallest id, ids before none, and of equal ids one text by its hash.

    An id may stand for different texts; rows go by id and text together.  Rows equal in both stay once.
    """
    placed = write_table(_placed(docs, id_col, text_col, shingle).select(F.col(id_col).alias("_id"), "text_key", "root"), "nearcopies-rows")
    rows = placed.groupBy("root", "_id", "text_key").agg(F.count("*").alias("n"))
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("i"), F.col("text_key").alias("t"))
    rows = write_table(rows.withColumn("at", order), "nearcopies-ids")
    first = rows.groupBy("root").agg(F.min("at").alias("first"), F.count("*").alias("ids"))
    of, key = fresh(docs, "of"), fresh(docs, "key")
    judged = write_table(attach_facts(rows, first, ["root"], "ids", ["_id", "text_key"]).select(
        F.col("_id").alias(of), F.col("text_key").alias(key), (F.col("at") == F.col("first")).alias("stays"), "n"), "nearcopies-judged")
    same = (F.col(f"`{id_col}`").eqNullSafe(F.col(of))) & (_text_key(f"`{text_col}`") == F.col(key))
    gone = judged.where(~F.col("stays")).select(of, key)
    kept = docs.join(small_or_shuffled(gone), same, "left_anti")
    again = judged.where(F.col("stays") & (F.col("n") > 1)).select(of, key)
    if not again.limit(1).count():
        return kept
    again = small_or_shuffled(again)
    return kept.join(again, same, "left_anti").unionByName(_once(kept.join(again, same, "left_semi"), id_col, text_col))


def _once(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each id and text, whatever its other columns hold: all of one row's, for the aggregate takes it as a whole."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    firsts = rows.groupBy(F.col(f"`{id_col}`").alias("_of"), _text_key(f"`{text_col}`").alias("_key")).agg(F.first(whole).alias("_row"))
    return firsts.select(*[F.col("_row").getField(c).alias(c) for c in rows.columns])
