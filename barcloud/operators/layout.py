"""Physical layouts of the per-barcode work, chosen by barcode and read size.

``BarcodeLocal``: rows are hash partitioned by barcode once; every later window has the barcode in
its key, so the whole resolution runs without another shuffle.  Only for barcodes that fit a task.

``Spread``: for heavy barcodes.  Rows are partitioned by read pair; facts about clouds, barcodes
and duplicate groups are aggregated with map-side partials and attached skew-safely.

``SpreadReads``: for barcodes with a heavy read pair.  Facts about reads are attached the same way,
and partners are searched in position bins.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barcloud.config import INSERT_MAX, INSERT_MIN, SkewPolicy
from barcloud.operators import clouds as C
from barcloud.operators.blocks import Blocks, pack
from barcloud.operators.candidates import PAIR, READ
from barcloud.operators.skew import attach_by_key, attach_small, bounded_dim
from barcloud.session import cut_lineage, replace_tables


def _tasks(df: DataFrame, policy: SkewPolicy, total_rows: int) -> int:
    """Enough tasks for bounded partitions, and several per core to even out barcode sizes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(policy.waves * cores, -(-total_rows // policy.rows_per_task))


def even_tasks(sizes: DataFrame, policy: SkewPolicy, total_rows: int) -> int:
    """The number of hash partitions, of ``policy.placements`` tried, whose largest has the fewest rows.

    ``sizes``: bc, n.  A barcode that weighs several tasks meets another in its task at almost any number.
    """
    least = _tasks(sizes, policy, total_rows)
    tried = sorted({least + least * k // policy.placements for k in range(policy.placements)})
    loads = (
        sizes.select(F.explode(F.array(*[F.lit(t) for t in tried])).alias("tasks"), F.hash("bc").alias("_h"), "n")
        .groupBy("tasks", F.pmod("_h", "tasks").alias("slot")).agg(F.sum("n").alias("n"))
        .groupBy("tasks").agg(F.max("n").alias("n")))
    return loads.agg(F.min_by("tasks", F.struct("n", "tasks"))).first()[0] or least


def _pair_order(*order: str) -> WindowSpec:
    return Window.partitionBy(*PAIR).orderBy(*order)


def _partner_max(value: Column, window: WindowSpec) -> Column:
    """Largest ``value`` among opposite-strand rows inside the insert window of the current row.

    Distance is reverse minus forward: reverse partners lie ahead, forward partners behind.
    """
    ahead = F.max(F.when(F.col("rev"), value)).over(window.rangeBetween(INSERT_MIN, INSERT_MAX))
    behind = F.max(F.when(~F.col("rev"), value)).over(window.rangeBetween(-INSERT_MAX, -INSERT_MIN))
    return F.coalesce(F.when(F.col("rev"), behind).otherwise(ahead), F.lit(0.0))


class PairWindows:
    """Per-read-pair work as windows of one sort order, for pairs that fit a task."""

    def pair_pass(self, df: DataFrame, facts: dict[str, Column], partners: dict[str, Column] | None = None) -> DataFrame:
        """Add facts of the read pair, and per row the largest partner value (NULL on own mate)."""
        order = _pair_order("gpos")
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumns({
            **{name: agg.over(whole) for name, agg in facts.items()},
            **{name: _partner_max(value, order) for name, value in (partners or {}).items()},
        })

    def repeats(self, df: DataFrame) -> DataFrame:
        """Add repeats.  Along gpos clouds only advance: the largest earlier cloud is the latest one."""
        before = _pair_order("gpos", "mate", "bwa_rank").rowsBetween(Window.unboundedPreceding, -1)
        latest = lambda m: F.max(F.when(F.col("mate") == m, F.col("gcloud"))).over(before)
        seen = F.when(F.col("mate") == 0, latest(0)).otherwise(latest(1))
        return df.withColumn("repeats", F.coalesce(seen == F.col("gcloud"), F.lit(False)))

    def read_facts(self, df: DataFrame, keys: list[str], facts: dict[str, Column]) -> DataFrame:
        group = Window.partitionBy(*keys)
        return df.withColumns({name: agg.over(group) for name, agg in facts.items()})

    def top_two(self, df: DataFrame, order: list[Column], fields: Column) -> DataFrame:
        """Best row per read, with ``_next`` = ``fields`` of the second one."""
        ranked = Window.partitionBy(*READ).orderBy(*order)
        marked = df.withColumns({"_rn": F.row_number().over(ranked), "_next": F.lead(fields).over(ranked)})
        return marked.where("_rn = 1").drop("_rn")


@dataclass(frozen=True)
class BarcodeLocal(PairWindows):
    """All rows of a barcode in one partition."""

    reshuffles = False
    policy: SkewPolicy
    total_rows: int
    tasks: int = 0  # of an even placement, where the sizes of the barcodes are known

    def place(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.tasks or _tasks(df, self.policy, self.total_rows), "bc")

    def pair_counts(self, df: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Add n_pairs, the read pairs of the barcode: as ``known`` (bc, n_pairs) has it, else those with a candidate."""
        if known is not None:
            # barcodes are light here: the rows keep their place and only ``known`` moves
            known = bounded_dim(cut_lineage(known), self.policy)
            return df.join(known, "bc", "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
        pair = Window.partitionBy("bc", "ident").orderBy("mate", "bwa_rank")
        first = F.when(F.row_number().over(pair) == 1, F.lit(1)).otherwise(F.lit(0))
        return df.withColumn("_first", first).withColumn(
            "n_pairs", F.sum("_first").over(Window.partitionBy("bc"))).drop("_first")

    def build_clouds(self, df: DataFrame, dist_thresh: int) -> DataFrame:
        return C.build_clouds(df, dist_thresh)

    def facts(self, df: DataFrame, keys: list[str], facts: dict[str, Column]) -> DataFrame:
        group = Window.partitionBy(*keys)
        return df.withColumns({name: agg.over(group) for name, agg in facts.items()})

    def ordinal(self, df: DataFrame, name: str) -> DataFrame:
        """Number the clouds of a barcode from 1."""
        order = Window.partitionBy("bc").orderBy("chrom", "cloud")
        return df.withColumn(name, F.dense_rank().over(order))

    def settle(self, df: DataFrame) -> DataFrame:
        return df


@dataclass(frozen=True)
class Spread(PairWindows):
    """Rows of a barcode spread by read pair."""

    reshuffles, pairs_fit = True, True
    policy: SkewPolicy
    total_rows: int
    _spent: set[str] = field(default_factory=set, repr=False, compare=False)
    _held: set[str] = field(default_factory=set, repr=False, compare=False)
    _until_rows: set[str] = field(default_factory=set, repr=False, compare=False)

    @property
    def threshold(self) -> int:
        return self.policy.threshold(self.total_rows)

    def place(self, df: DataFrame) -> DataFrame:
        return df.repartition(_tasks(df, self.policy, self.total_rows), "bc", "ident")

    def pair_counts(self, df: DataFrame, known: DataFrame | None = None) -> DataFrame:
        pairs = df.groupBy("bc", "ident").agg(F.count("*").alias("_n"))
        counts = pairs.groupBy("bc").agg(F.count("*").alias("n_pairs"), F.sum("_n").alias("_rows"))
        if known is not None:
            counts = counts.drop("n_pairs").join(known, "bc", "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
        heavy = F.col("_rows") > self.threshold
        return attach_small(df, self._small(counts), ["bc"], heavy, ["ident"], self.policy).drop("_rows")

    def build_clouds(self, df: DataFrame, dist_thresh: int) -> DataFrame:
        return C.build_clouds_spread(df, dist_thresh, self.total_rows, self.policy, self._small)

    def facts(self, df: DataFrame, keys: list[str], facts: dict[str, Column]) -> DataFrame:
        self._settle_small()
        settled = self.settle(df)
        table = settled.groupBy(*keys).agg(
            *[agg.alias(name) for name, agg in facts.items()], F.count("*").alias("_n"))
        spread_on = [c for c in ("ident", "mate", "pos") if c in settled.columns]
        kept = settled.drop(*facts)
        return attach_by_key(kept, table, keys, F.col("_n") > self.threshold, spread_on).drop("_n")

    def ordinal(self, df: DataFrame, name: str) -> DataFrame:
        settled = self.settle(df)
        # one row per cloud: clouds of a barcode are dist_thresh apart, so the genome bounds them
        table = settled.groupBy(*C.CLOUD).agg(F.count("*").alias("_n")).withColumn(
            name, F.row_number().over(Window.partitionBy("bc").orderBy("chrom", "cloud")))
        heavy = F.col("_n") > self.threshold
        return attach_small(settled, self._small(table), C.CLOUD, heavy, ["ident", "mate"], self.policy).drop("_n")

    def top_two(self, df: DataFrame, order: list[Column], fields: Column) -> DataFrame:
        return super().top_two(self.place(df), order, fields)

    def settle(self, df: DataFrame) -> DataFrame:
        """Rows feed both an aggregate and the join with it: compute them once, reliably.

        The settled tables that ``df`` was made of are deleted: go on with the result, not with ``df``.
        """
        return replace_tables(df, "settled", self._spent, self._held)

    @contextmanager
    def beside(self, df: DataFrame):
        """``df`` settled, and kept while the block settles rows made of it."""
        self._settle_small()
        table, new = self.hold(df)
        try:
            yield table
        finally:
            self.release(new)

    def hold(self, df: DataFrame) -> tuple[DataFrame, set[str]]:
        """``df`` settled, and its paths, which stay until they are released."""
        before = set(self._spent)
        table = self.settle(df)
        new = self._spent - before
        self._held.update(new)
        return table, new

    def _small(self, facts: DataFrame) -> DataFrame:
        """``facts`` settled, and kept until rows they are attached to are."""
        before = set(self._held)
        self._held.update(self._spent)  # the rows are still to be read
        try:
            table, paths = self.hold(facts)
        finally:
            self._held.intersection_update(before)
        self._held.update(paths)
        self._until_rows.update(paths)
        return table

    def _settle_small(self) -> None:
        self.release(self._until_rows)
        self._until_rows.clear()

    def release(self, paths: set[str]) -> None:
        self._held.difference_update(paths)

    @contextmanager
    def packed(self, df: DataFrame, working: list[str]):
        """``df`` in blocks of read pairs, kept while the block settles rows made of them."""
        with self.beside(pack(df, working, _tasks(df, self.policy, self.total_rows))) as table:
            yield Blocks(table, df.schema, self.policy)

    @contextmanager
    def by_pair_size(self, df: DataFrame):
        """(rows of the read pairs that fit a task, settled rows of the others or None)."""
        yield df, None


_BIN = 1024  # positions; wider than the insert window, so a partner lies in a neighbouring bin


@dataclass(frozen=True)
class SpreadReads(Spread):
    """Rows spread without regard to barcode or read: no group is ever brought to one task; rounds take pairs that fit one in blocks."""

    pairs_fit = False

    def place(self, df: DataFrame) -> DataFrame:
        return df

    @contextmanager
    def by_pair_size(self, df: DataFrame):
        self._settle_small()
        rows, of_rows = self.hold(df)
        # at most max_heavy_keys pairs can pass
        sizes = rows.groupBy(*PAIR).agg(F.count("*").alias("_n")).where(F.col("_n") > self.threshold).select(*PAIR)
        keys, heavy, of_heavy = sizes.collect(), None, set()
        if keys:
            marked = F.broadcast(rows.sparkSession.createDataFrame(keys, sizes.schema))
            same = lambda: [rows[k].eqNullSafe(marked[k]) for k in PAIR]
            heavy, of_heavy = self.hold(rows.join(marked, same(), "left_semi"))
            rows = rows.join(marked, same(), "left_anti")
        self.release(of_rows)
        try:
            yield rows, heavy
        finally:
            self.release(of_heavy)

    def read_facts(self, df: DataFrame, keys: list[str], facts: dict[str, Column]) -> DataFrame:
        return self.facts(df, keys, facts)

    def pair_pass(self, df: DataFrame, facts: dict[str, Column], partners: dict[str, Column] | None = None) -> DataFrame:
        if facts:
            df = self.facts(df, PAIR, facts)
        for name, value in (partners or {}).items():
            df = self._with_partner(df, name, value)
        return df

    def _with_partner(self, df: DataFrame, name: str, value: Column) -> DataFrame:
        settled = self.settle(df)
        site = [*PAIR, "rev", "gpos"]
        # one row per position and strand: the positions around a bin bound every window group
        sites = settled.groupBy(*site).agg(F.max(value).alias("_v"), F.count("*").alias("_n"))
        bin_of = lambda p: F.floor(p / _BIN)
        near = F.sequence(bin_of(F.col("gpos") - INSERT_MAX), bin_of(F.col("gpos") + INSERT_MAX))
        spots = sites.select(*site, "_v", "_n", F.explode(near).alias("_bin")).withColumn(
            "_mine", F.col("_bin") == bin_of(F.col("gpos")))
        window = Window.partitionBy(*PAIR, "_bin").orderBy("gpos")
        found = spots.withColumn(name, _partner_max(F.col("_v"), window)).where("_mine").select(*site, name, "_n")
        return attach_by_key(settled, found, site, F.col("_n") > self.threshold, ["mate", "bwa_rank"]).drop("_n")

    def repeats(self, df: DataFrame) -> DataFrame:
        place = F.struct("pos", "bwa_rank")
        known = self.facts(df, [*READ, "chrom", "cloud"], {"_earliest": F.min(place)})
        return known.withColumn("repeats", place > F.col("_earliest")).drop("_earliest")

    def top_two(self, df: DataFrame, order: list[Column], fields: Column) -> DataFrame:
        settled = self.settle(df.withColumn("_order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])))
        row = F.struct(*df.columns)
        best = settled.groupBy(*READ).agg(
            F.min_by(row, "_order").alias("_row"), F.min("_order").alias("_best"), F.count("*").alias("_n"))
        rest = attach_by_key(
            settled, best.select(*READ, "_best", "_n"), READ, F.col("_n") > self.threshold, ["pos", "bwa_rank"])
        second = rest.where(F.col("_order") != F.col("_best")).groupBy(*READ).agg(F.min_by(fields, "_order").alias("_next"))
        return best.join(second, READ, "left").select("_row.*", "_next")
