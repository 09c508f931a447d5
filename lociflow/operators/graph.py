"""Connected components and chains by iterated joins."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lociflow.session import cut_lineage, spread

MAX_ROUNDS = 200


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` with the smallest node of each component.

    Every round a node, and the node it points at, take the smallest pointer seen
    across an edge; then pointers jump to their pointer's pointer. The number of
    rounds grows with the logarithm of the diameter. Each reduction is a minimum,
    so a hub's edges are combined before they are shuffled.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut_lineage(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    point = cut_lineage(both.groupBy(F.col("u").alias("node"))
                        .agg(F.least(F.first("u"), F.min("v")).alias("to")))
    for _ in range(MAX_ROUNDS):
        of_u = point.select(F.col("node").alias("u"), F.col("to").alias("tu"))
        of_v = point.select(F.col("node").alias("v"), F.col("to").alias("tv"))
        seen = both.join(spread(of_u), "u").join(spread(of_v), "v").where(F.col("tv") < F.col("tu"))
        offers = seen.select(F.explode(F.array("u", "tu")).alias("node"), F.col("tv").alias("offer"))
        best = offers.groupBy("node").agg(F.min("offer").alias("offer"))
        hooked = point.join(spread(best), "node", "left").select(
            "node", F.least("to", F.coalesce("offer", "to")).alias("to"), F.col("to").alias("was"))
        jump = hooked.select(F.col("node").alias("to"), F.col("to").alias("next"))
        moved = cut_lineage(hooked.join(spread(jump), "to").select(
            "node", F.least("to", "next").alias("to"), "was"))
        changed = moved.where(F.col("to") != F.col("was")).limit(1).count()
        point = moved.drop("was")
        if not changed:
            return point.select("node", F.col("to").alias("component"))
    raise RuntimeError("components did not settle")


def chain_roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, root)``: the first node of the chain each node belongs to.

    ``links(pred, succ)`` gives every node at most one predecessor and one
    successor. Pointers to the predecessor double their reach each round.
    """
    at = cut_lineage(nodes.select("id").join(spread(links.select(F.col("succ").alias("id"), F.col("pred").alias("to"))), "id", "left")
                     .select("id", F.coalesce("to", "id").alias("to")))
    for _ in range(MAX_ROUNDS):
        ahead = at.select(F.col("id").alias("to"), F.col("to").alias("next"))
        moved = cut_lineage(at.join(spread(ahead), "to").select("id", F.col("next").alias("to"), F.col("to").alias("was")))
        changed = moved.where(F.col("to") != F.col("was")).limit(1).count()
        at = moved.drop("was")
        if not changed:
            return at.select("id", F.col("to").alias("root"))
    raise RuntimeError("chains did not settle")
