"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from panelfx.session import freeze

MAX_ROUNDS = 60


def hook_to_smallest(links: DataFrame) -> DataFrame:
    """Large star: every neighbour above a node is linked to the node's smallest neighbour instead."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_least"))
    return (
        both.where("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.least("a", "_least").alias("b"))
        .distinct()
    )


def hook_parents(links: DataFrame) -> DataFrame:
    """Small star: a node's smaller neighbours are linked to the smallest of them (a > b throughout)."""
    least = links.groupBy("a").agg(F.min("b").alias("_least"))
    moved = links.join(least, "a").where("b > _least").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    return moved.unionByName(least.select("a", F.col("_least").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (columns a and b, bigint); component = smallest node.

    Self links and repeated links are ignored, rows with a null end too. Every round is two
    aggregations with partial sums and two joins that adaptive execution may split at a hot node;
    the number of links never grows, and rounds are logarithmic in the number of nodes. Each round
    is written to the shared folder, so a lost executor costs no earlier round; what tells that nothing
    changed any more is counted while it is written.
    """
    now = freeze(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        seen_now = Observation()
        links_sum = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        now = freeze(hook_parents(hook_to_smallest(now)).observe(seen_now, F.count("*").alias("n"), links_sum.alias("sum")), "stars")
        state = seen_now.get
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("a"), "b").distinct()
    return now.unionByName(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))
