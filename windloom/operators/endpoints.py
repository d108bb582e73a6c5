"""Poles at the ends of routes: ends that belong to one node and stand close together share a structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.operators.routing import tree_edges
from windloom.sources.lineage import cut

#: Two ends this far apart, in metres, may still share a pole (test binding).
TOLERANCE = 3


def clusters(ends: DataFrame, tolerance: float) -> DataFrame:
    """Ends (project, topology, route, x, y) with ``cluster``, the first route of the cluster each one joins.

    In order of their routes, an end joins the first cluster of its node all of whose members are within the tolerance (inclusive),
    or begins one. What an end does depends only on earlier ends within twice the tolerance, so all ends whose earlier
    neighbours have settled are settled at once, round after round; neighbours meet by cells, no other pairs. Ends at one
    place always go together, so a node that very many routes share is one row.

    Defined results: ends without a node or a coordinate stand alone; ends of one route at one node are one end if they are at one
    place; repeated rows count once; an empty table gives an empty one.
    """
    place, one = ["project", "topology", "x", "y"], F.col("topology").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    points = ends.where(one).groupBy(*place).agg(F.min("route").alias("first"))
    points = cut(points.withColumn("id", F.struct("first", "x", "y")))  # unique within a node, in order of routes
    size = max(2.0 * tolerance, 1.0)
    cell = lambda c, i: F.floor(F.col(c) / size) + i
    around = F.explode(F.array(*[F.struct(cell("x", i).alias("cx"), cell("y", j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    here = points.select("project", "topology", "id", around.alias("c")).select("project", "topology", "id", "c.*")
    there = points.select("project", "topology", F.col("id").alias("before"), cell("x", 0).alias("cx"), cell("y", 0).alias("cy"))
    dx, dy = F.col("id.x") - F.col("before.x"), F.col("id.y") - F.col("before.y")
    met = here.join(there, ["project", "topology", "cx", "cy"]).where("before < id").withColumn("d2", (dx * dx + dy * dy).cast("double"))
    pairs = cut(met.where(F.col("d2") <= 4.0 * tolerance * tolerance).select("project", "topology", "id", "before", (F.col("d2") <= tolerance * tolerance).alias("near")))
    key = ["project", "topology", "id"]
    settled = cut(points.join(pairs.select(*key).distinct(), key, "left_anti").select(*key, F.col("id").alias("cluster")))
    open_ = cut(pairs.select(*key).distinct())
    while not open_.isEmpty():
        waiting = pairs.join(open_.withColumnRenamed("id", "before"), ["project", "topology", "before"], "left_semi").select(*key).distinct()
        ready = cut(open_.join(waiting, key, "left_anti"))
        seen = pairs.join(ready, key, "left_semi").join(settled.withColumnRenamed("id", "before"), ["project", "topology", "before"])
        fit = seen.groupBy(*key, "cluster").agg(F.bool_and("near").alias("fits")).where("fits").groupBy(*key).agg(F.min("cluster").alias("cluster"))
        now = ready.join(fit, key, "left").select(*key, F.coalesce("cluster", "id").alias("cluster"))
        settled, open_ = cut(settled.unionByName(now)), cut(open_.join(ready, key, "left_anti"))
    joined = ends.where(one).join(points.select(*place, "id"), place).join(settled, key).drop("id")
    alone = ends.where(~one | F.isnull("topology") | F.isnull("x") | F.isnull("y"))
    lone = alone.select(*ends.columns, F.struct(F.col("route").alias("first"), "x", "y").alias("cluster"))
    return joined.select(*ends.columns, "cluster").unionByName(lone).distinct()


def route_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of each tree edge, a little off their node's place (test binding): topology 0 is the substation."""
    number = F.col("feeder") * 100 + F.col("node")
    parent = F.floor(F.col("node") / 2).cast("int")
    ends = F.array(
        F.struct(number.alias("topology"), (F.col("x1") + number * 7 % 5).alias("x"), (F.col("y1") + number * 11 % 4).alias("y")),
        F.struct(F.when(parent > 0, F.col("feeder") * 100 + parent).otherwise(0).alias("topology"), (F.col("x2") + number * 13 % 6).alias("x"), (F.col("y2") + number * 17 % 5).alias("y")),
    )
    return tree_edges(spark, sf_dir).select("project", number.alias("route"), F.explode(ends).alias("e")).select("project", "route", "e.*")


def endpoint_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One structure for each cluster of route ends, at the place of its first route: a junction if several routes share it."""
    found = clusters(route_ends(spark, sf_dir), TOLERANCE)
    each = found.groupBy("project", "topology", "cluster").agg(F.count_distinct("route").alias("n_routes"), F.min(F.struct("route", "x", "y")).alias("at"), F.array_join(F.array_sort(F.collect_set("route")).cast("array<string>"), ",").alias("routes"))  # of one structure
    identity = F.concat_ws("|", F.col("project").cast("string"), F.col("topology").cast("string"), F.col("routes"))
    several = F.col("n_routes") > 1
    return each.select("project", "topology", F.col("at.route").alias("first_route"), F.col("at.x").alias("x"), F.col("at.y").alias("y"), "n_routes", F.when(several, "junction").otherwise("terminal").alias("kind"), F.when(several, F.concat(F.lit("JUNCTION-"), F.substring(F.sha2(identity, 256), 1, 12))).alias("pole_id"))


QUERIES = (endpoint_clusters,)
