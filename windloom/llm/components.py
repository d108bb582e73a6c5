"""Connected components of a link table by alternating large-star and small-star steps (a published method).

No step gathers a node's neighbours: each one is a minimum per node and a join back, so a hub with millions of links
is an aggregation like any other. Lineage is cut by a written table after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_heavy


def _with_least(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """u, v and m, the least neighbour of u. A hub's links stay where they are: its one row is broadcast."""
    least = scratch.save(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), name)
    return join_heavy(edges, least, ["u"], "degree", edges.count()).drop("degree")


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _with_least(both, scratch, name).withColumn("m", F.least("u", "m"))
    return least.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _with_least(down, scratch, name)
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(joined.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v) of distinct, non-null nodes in any direction; gives node and label, the component's least node.

    Nodes without a link aren't listed; an empty table gives an empty one.
    """
    current, before, saved = scratch.save(edges.select("u", "v").where("u <> v"), "edges-0"), None, "edges-0"
    for k in range(1, max_rounds + 1):
        wide = scratch.save(_large_star(current, scratch, f"least-{k}"), f"wide-{k}")
        after = scratch.save(_small_star(wide, scratch, f"small-least-{k}"), f"edges-{k}")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for name in (saved, f"least-{k}", f"wide-{k}", f"small-least-{k}"):
            scratch.drop(name)
        current, saved = after, f"edges-{k}"
        if state == before or state[0] == 0:
            break
        before = state
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
