"""Prior- and quality-weighted barcode correction as an equi-join on edited barcodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barcloud.config import (
    BC_LEN, CONFIDENCE, DEFAULT_POLICY, H1CHANGE, H2CHANGE, NOBUCKET, NOCHANGE, SkewPolicy,
)
from barcloud.functions import bases as B
from barcloud.operators.skew import attach_by_key, fits_broadcast


def barcode_priors(whitelist: DataFrame, counts: DataFrame) -> DataFrame:
    """(bc, n, prior): add-one smoothing over the whole whitelist, zero counts included."""
    counted = whitelist.join(counts, "bc", "left").select("bc", F.coalesce("n", F.lit(0)).alias("n"))
    total = counted.agg(F.sum(F.col("n") + 1).alias("total")).scalar()
    return counted.withColumn("prior", (F.col("n") + 1) / total)


def _shift(position) -> int:
    """Bit offset of a base position counted from the first base."""
    return 2 * (BC_LEN - 1 - position)


# Edits as (XOR mask, first position, second position); position -1 stands for "none".
_SAME = [(0, -1, -1)]
_SINGLE = [(x << _shift(i), i, -1) for i in range(BC_LEN) for x in (1, 2, 3)]
_DOUBLE = [
    ((x << _shift(i)) | (y << _shift(j)), i, j)
    for i in range(BC_LEN) for j in range(i + 1, BC_LEN) for x in (1, 2, 3) for y in (1, 2, 3)
]


def _constants(values: list[int], kind: str) -> Column:
    return F.lit(values).cast(f"array<{kind}>")


def _masked_hits(observed: DataFrame, priors: DataFrame) -> DataFrame:
    """Single-edit hits by joining both sides on the barcode with one position masked.

    A masked code is shared by at most four barcodes on either side, so no group can grow.
    """
    masks = F.array(*[
        F.struct(F.lit(i).cast("tinyint").alias("i"), F.lit(3 << _shift(i)).cast("long").alias("m"))
        for i in range(BC_LEN)
    ])
    clear = lambda c: F.col(c).bitwiseAND(F.bitwise_not(F.col("m"))).alias("masked")
    # a whitelisted barcode has no single edits to try: only the others are multiplied
    marked = observed.join(priors.select("bc", "prior"), "bc", "left")
    known = F.col("n_pos").isNull() & F.col("prior").isNotNull()
    left = (
        marked.where(~known).select("bases", "n_keys", "n_pos", "bc", F.inline(masks))
        .where(F.col("n_pos").isNull() | (F.col("n_pos") == F.col("i")))
        .select("bases", "n_keys", "n_pos", "bc", "i", clear("bc"))
    )
    right = priors.select("bc", "prior", F.inline(masks)).select(
        F.col("bc").alias("cand"), "prior", "i", clear("bc")
    )
    near = left.join(right, ["i", "masked"]).where(F.col("n_pos").isNotNull() | (F.col("bc") != F.col("cand")))
    own = marked.where(known).withColumn("cand", F.col("bc")).withColumn("i", F.lit(-1).cast("tinyint"))
    minus = F.lit(-1).cast("tinyint").alias("j")
    return near.select("bases", "n_keys", "cand", "i", minus, "prior").unionByName(
        own.select("bases", "n_keys", "cand", "i", minus, "prior"))


def _masked_double_hits(observed: DataFrame, priors: DataFrame) -> DataFrame:
    """Double-edit hits by joining on the barcode with two positions masked (groups of at most 16)."""
    masks = F.array(*[
        F.struct(F.lit(i).cast("tinyint").alias("i"), F.lit(j).cast("tinyint").alias("j"),
                 F.lit(3 << _shift(i)).cast("long").alias("mi"), F.lit(3 << _shift(j)).cast("long").alias("mj"))
        for i in range(BC_LEN) for j in range(i + 1, BC_LEN)
    ])
    clear = F.col("bc").bitwiseAND(F.bitwise_not(F.col("mi").bitwiseOR(F.col("mj")))).alias("masked")
    known = observed.where(F.col("n_pos").isNull()).join(priors.select("bc"), "bc", "left_semi")
    left = known.select("bases", "n_keys", "bc", F.inline(masks)).select(
        "bases", "n_keys", "bc", "i", "j", "mi", "mj", clear)
    right = priors.select("bc", "prior", F.inline(masks)).select(F.col("bc").alias("cand"), "prior", "i", "j", clear)
    diff = F.col("bc").bitwiseXOR(F.col("cand"))
    both = (diff.bitwiseAND(F.col("mi")) != 0) & (diff.bitwiseAND(F.col("mj")) != 0)
    return left.join(right, ["i", "j", "masked"]).where(both).select("bases", "n_keys", "cand", "i", "j", "prior")


def _neighbour_hits(observed: DataFrame, priors: DataFrame, double: bool) -> DataFrame:
    """Hits by probing edited barcodes in the broadcast whitelist: no shuffle of the edits.

    One join tells the whitelisted ones and one probes all that is tried, so the driver builds the whitelist's table at most twice.
    """
    dim = F.broadcast(priors.where(F.col("bc").isNotNull()).select(F.col("bc").alias("cand"), "prior"))
    with_n = F.col("n_pos").isNotNull()
    marked = observed.withColumn("_own", F.when(~with_n, F.col("bc"))).join(
        dim.withColumnsRenamed({"cand": "_own", "prior": "_prior"}), "_own", "left")
    # a whitelisted barcode has no single edits to try: only the others are multiplied
    known = F.col("_prior").isNotNull()
    own = _SAME + (_DOUBLE if double else [])
    masks = lambda edits: _constants([m for m, _, _ in edits], "bigint")
    # the four fillings of the single N, a barcode itself, or its edits
    tries = F.when(with_n, _constants([0, 1, 2, 3], "bigint")).when(known, masks(own)).otherwise(masks(_SINGLE))
    units = _constants([1 << _shift(i) for i in range(BC_LEN)], "bigint")
    tried = marked.select("bases", "n_keys", "n_pos", "bc", known.alias("_known"), F.posexplode(tries).alias("e", "mask"))
    code = F.when(with_n, F.col("bc") + F.col("mask") * F.get(units, F.col("n_pos"))).otherwise(F.col("bc").bitwiseXOR(F.col("mask")))
    # positions are only looked up for hits
    hits = tried.select("bases", "n_keys", "n_pos", "_known", "e", code.alias("cand")).join(dim, "cand")
    at = lambda edits, k: F.get(_constants([edit[k] for edit in edits], "tinyint"), F.col("e"))
    position = lambda k, of_n: F.when(with_n, of_n.cast("tinyint")).when(F.col("_known"), at(own, k)).otherwise(at(_SINGLE, k))
    return hits.select("bases", "n_keys", "cand", position(1, F.col("n_pos")).alias("i"), position(2, F.lit(-1)).alias("j"), "prior")


def observed_bases(keys: DataFrame) -> DataFrame:
    """(bases, n_keys, n_pos, bc): distinct base strings with at most one N."""
    n_pos = F.when(F.col("bases").contains("N"), F.instr("bases", "N") - 1)
    return (
        keys.where(B.n_count("bases") <= 1)
        .groupBy("bases").agg(F.count("*").alias("n_keys"))
        .withColumns({"n_pos": n_pos, "bc": B.pack("bases")})
    )


def neighbour_table(
    keys: DataFrame, priors: DataFrame, double: bool = False,
    policy: SkewPolicy = DEFAULT_POLICY, broadcast: bool | None = None,
) -> DataFrame:
    """(bases, n_keys, known_prior, hits): whitelisted neighbours of every observed base string.

    Edits depend on the bases alone, so they are joined once per distinct base string; a base
    string has at most 48 single or 1080 double edits, which bounds the hits array.
    """
    observed = observed_bases(keys)
    if broadcast is None:
        broadcast = fits_broadcast(priors.select("bc"), policy)
    if broadcast:
        hits = _neighbour_hits(observed, priors, double)
    else:
        hits = _masked_hits(observed, priors)
        if double:
            hits = hits.unionByName(_masked_double_hits(observed, priors))
    hit = F.when(F.col("i") >= 0, F.struct("cand", "i", "j", "prior"))
    # n_keys is a grouping column so that filters on it reach the distinct base strings
    return hits.groupBy("bases", "n_keys").agg(
        F.max(F.when(F.col("i") < 0, F.col("prior"))).alias("known_prior"),
        F.collect_list(hit).alias("hits"),
    )


def correct_keys(
    keys: DataFrame, priors: DataFrame, double: bool = False,
    policy: SkewPolicy = DEFAULT_POLICY, broadcast: bool | None = None,
) -> DataFrame:
    """(bases, quals, n, outcome, assigned, max_p, total) per quality-aware key.

    ``assigned`` is the accepted barcode (raw or corrected), NULL when there is none.
    """
    table = neighbour_table(keys, priors, double, policy, broadcast)
    # A base string can have any number of quality strings: attach its hits skew-safely.
    share = keys.agg(F.count("*") / policy.max_heavy_keys).scalar()
    heavy = F.col("n_keys") > F.greatest(F.lit(float(policy.max_group_rows)), share)
    joined = attach_by_key(keys, table, ["bases"], heavy, ["quals"])
    quality = lambda pos: B.qual_at("quals", pos.cast("int"))
    single = lambda h: h["prior"] * B.phred_prob(quality(h["i"]))
    damped = lambda pos: B.phred_prob(F.greatest(F.lit(3), quality(pos) - 1))
    pair = lambda h: h["prior"] * (damped(h["i"]) * damped(h["j"]))
    known = F.col("known_prior").isNotNull()
    # single edits are tried for unknown barcodes, double edits for known ones
    relevant = F.filter("hits", lambda h: known == (h["j"] >= 0))
    weighted = F.transform(
        relevant,
        lambda h: F.struct(F.when(h["j"] >= 0, pair(h)).otherwise(single(h)).alias("p"), h["cand"].alias("cand")),
    )
    weighed = joined.withColumn("weighted", F.coalesce(weighted, F.array().cast("array<struct<p:double,cand:bigint>>")))
    best = F.array_max("weighted")
    own = F.coalesce("known_prior", F.lit(-1.0))
    edited = F.coalesce(best["p"] > own, F.lit(False))
    total = F.aggregate("weighted", F.coalesce("known_prior", F.lit(0.0)), lambda acc, w: acc + w["p"])
    scored = weighed.select(
        "bases", "quals", "n", "known_prior", edited.alias("edited"),
        F.when(edited, best["p"]).otherwise(own).alias("max_p"),
        F.when(edited, best["cand"]).otherwise(F.when(known, B.pack("bases"))).alias("best"),
        total.alias("total"),
    )
    accepted = F.coalesce((F.col("total") > 0) & (F.col("max_p") / F.col("total") > CONFIDENCE), F.lit(False))
    label = (
        F.when(~accepted, NOBUCKET).when(~F.col("edited"), NOCHANGE)
        .when(F.col("known_prior").isNull(), H1CHANGE).otherwise(H2CHANGE)
    )
    return scored.select(
        "bases", "quals", "n", label.alias("outcome"), F.when(accepted, F.col("best")).alias("assigned"),
        "max_p", "total",
    )


def outcome_histogram(corrected: DataFrame) -> DataFrame:
    return corrected.groupBy("outcome").agg(F.sum("n").alias("n_reads"))


def corrected_counts(corrected: DataFrame) -> DataFrame:
    """(bc, n): reads per finally accepted barcode."""
    accepted = corrected.where(F.col("assigned").isNotNull())
    return accepted.groupBy(F.col("assigned").alias("bc")).agg(F.sum("n").alias("n"))


def replacement_map(corrected: DataFrame) -> DataFrame:
    """(bases, quals, n, assigned) of the keys whose barcode changes."""
    return corrected.where(F.col("outcome").isin(H1CHANGE, H2CHANGE)).select("bases", "quals", "n", "assigned")
