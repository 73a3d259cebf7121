"""Components of clouds that share a read, by star contraction, and cloud weights within them.

Clouds of one barcode are linked where a read (barcode, pair, mate) has candidates in both.  A read is no node: its least
cloud is linked with its other clouds.  Then large and small stars alternate: every node links its greater neighbours to the
least it knows, then its lesser neighbours and itself, until each component is one star around its least cloud;
the number of rounds grows with the logarithm of the graph.  What a node knows is an aggregate, attached by
key so that hubs (and reads with very many candidates) are dealt over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcloud.config import DEFAULT_POLICY, SkewPolicy
from barcloud.operators.clouds import CLOUD
from barcloud.operators.skew import attach_by_key
from barcloud.session import write_table

#: A cloud's number within its barcode: contig, then position.
_POSITION_BITS = 40


def cloud_number():
    return F.shiftleft(F.col("chrom").cast("long"), _POSITION_BITS) + F.col("cloud")


def _least_attached(edges: DataFrame, group: list[str], policy: SkewPolicy) -> DataFrame:
    """``edges`` (group, u, v) with ``least``: the smallest v of each u."""
    facts = write_table(edges.groupBy(*group, "u").agg(F.min("v").alias("least"), F.count("*").alias("_n")), "star-least")
    total = facts.agg(F.sum("_n")).first()[0] or 0
    return attach_by_key(edges, facts, [*group, "u"], F.col("_n") > policy.threshold(total), ["v"]).drop("_n")


def _large_star(edges: DataFrame, group: list[str], policy: SkewPolicy) -> DataFrame:
    both = edges.unionByName(edges.select(*group, F.col("v").alias("u"), F.col("u").alias("v")))
    known = _least_attached(both, group, policy).withColumn("least", F.least("least", "u"))
    return known.where("v > u").select(*group, F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame, group: list[str], policy: SkewPolicy) -> DataFrame:
    known = _least_attached(edges, group, policy)  # u > v in every edge here
    own = known.select(*group, "u", F.col("least").alias("v"))
    lesser = known.where("v <> least").select(*group, F.col("v").alias("u"), F.col("least").alias("v"))
    return own.unionByName(lesser).distinct()


def connected(links: DataFrame, group: list[str], member: list[str], node: str, policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """(group, node, component): nodes of ``links`` that share a ``member``, chained; a component is named by its least node.

    Null nodes or groups take no part.  Nothing is capped: rounds go on until no edge changes.
    """
    rows = links.select(*group, *member, F.col(node).alias("u")).where(F.col("u").isNotNull()).distinct()
    rows = write_table(rows, "star-rows")
    facts = rows.groupBy(*group, *member).agg(F.min("u").alias("v"), F.count("*").alias("_n"))
    total = rows.count()
    first = attach_by_key(rows, facts.where("_n > 1"), [*group, *member], F.col("_n") > policy.threshold(total), ["u"])
    edges = write_table(first.where("u > v").select(*group, "u", "v").distinct(), "star-edges")
    mark = None
    while mark != (mark := edges.agg(F.count("*"), F.sum(F.xxhash64(*group, "u", "v").cast("decimal(38,0)"))).first()):
        edges = write_table(_large_star(edges, group, policy), "star-edges")
        edges = write_table(_small_star(edges, group, policy), "star-edges")
    nodes = rows.select(*group, "u").distinct()
    # one edge a node is left, from it to its root
    return nodes.join(edges, [*group, "u"], "left").select(*group, F.col("u").alias(node), F.coalesce("v", "u").alias("component"))


def cloud_components(clouded: DataFrame, policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """(bc, chrom, cloud, component, n_clouds, weight, share) of candidates with ``cloud`` and ``gamma``.

    ``component`` is the number of its least cloud, ``weight`` the sum of the cloud's gammas, and ``share`` its part of the component's
    weights (null where they are all zero).
    """
    numbered = clouded.withColumn("_node", cloud_number())
    weights = write_table(numbered.groupBy(*CLOUD, "_node").agg(F.sum("gamma").alias("weight")), "cloud-weights")
    found = write_table(connected(numbered, ["bc"], ["ident", "mate"], "_node", policy), "cloud-components")
    rows = weights.join(found, ["bc", "_node"])
    totals = write_table(rows.groupBy("bc", "component").agg(F.count("*").alias("n_clouds"), F.sum("weight").alias("_total")), "component-weights")
    n = totals.agg(F.sum("n_clouds")).first()[0] or 0
    held = attach_by_key(rows, totals, ["bc", "component"], F.col("n_clouds") > policy.threshold(n), ["_node"])
    share = F.when(F.col("_total") > 0, F.col("weight") / F.col("_total"))
    return held.select(*CLOUD, "component", "n_clouds", "weight", share.alias("share"))
