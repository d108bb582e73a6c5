"""Cost surfaces of projects: extent and resolution from the data, constraint discs as cells, cells and cost of straight legs.

Rows count from the north edge down, columns from the west edge; both begin at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.operators.intake import MAX_CELLS
from windloom.operators.routing import ROOT, SOFT_WEIGHT, layers, tree_edges
from windloom.sources import bindings

#: Finest and coarsest resolution a request may ask for, in metres.
FINEST, COARSEST = 5, 100
#: Resolution of the registered queries and margin around a project's assets, in metres.
RESOLUTION, PADDING = 100, 100
#: How near to a line of the grid, in cells, a point lies on it.
ON_LINE = 1e-9


def surfaces_of(points: DataFrame, resolution: int = RESOLUTION, padding: int = PADDING, max_cells: int = MAX_CELLS) -> DataFrame:
    """Surface of each project (project, x, y): west, north, resolution_m, width, height, accepted.

    A surface of over ``max_cells`` cells is coarsened to whole metres; if it still has too many it isn't accepted. Points
    without both coordinates don't count; a project of such points only has no surface.
    """
    if not FINEST <= resolution <= COARSEST:
        raise ValueError(f"resolution must be between {FINEST} and {COARSEST} m")
    box = points.where("x is not null and y is not null").groupBy("project").agg((F.min("x") - padding).alias("west"), (F.max("x") + padding).alias("east"), (F.min("y") - padding).alias("south"), (F.max("y") + padding).alias("north"))
    across = lambda a, b, r: F.greatest(F.lit(1), F.ceil((F.col(b) - F.col(a)) / r))
    cells = lambda r: across("west", "east", r) * across("south", "north", r)
    asked = F.lit(resolution)
    used = F.when(cells(asked) > max_cells, F.greatest(asked, F.ceil(asked * F.sqrt(cells(asked) / F.lit(float(max_cells)))))).otherwise(asked).cast("long")
    found = box.withColumn("resolution_m", used)
    r = F.col("resolution_m")
    return found.select("project", "west", "north", "resolution_m", across("west", "east", r).alias("width"), across("south", "north", r).alias("height"), (cells(r) <= max_cells).alias("accepted"))


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface of each project's turbines and substation."""
    points = bindings.turbines(spark, sf_dir).select("project", "x", "y")
    root = points.select("project").distinct().select("project", F.lit(ROOT).alias("x"), F.lit(ROOT).alias("y"))
    return surfaces_of(points.unionByName(root))


def column_at(x: Column) -> Column:
    return F.floor((x - F.col("west")) / F.col("resolution_m"))


def row_at(y: Column) -> Column:
    return F.floor((F.col("north") - y) / F.col("resolution_m"))


def disc_cells(discs: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Cells of accepted surfaces whose centre a disc (project, lx, ly, r, hard) covers: blocked by a hard one, else dearer by each soft one."""
    on = discs.join(surfaces.where("accepted"), "project")
    span = lambda low, high, size: F.when((high >= 0) & (low < F.col(size)), F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.col(size) - 1)))
    x, y, r, size = F.col("lx"), F.col("ly"), F.col("r"), F.col("resolution_m")
    cells = on.withColumn("col", F.explode(span(column_at(x - r), column_at(x + r), "width"))).withColumn("row", F.explode(span(row_at(y + r), row_at(y - r), "height")))
    # twice the distances, so that centres stay whole
    dx, dy = 2 * (F.col("west") + F.col("col") * size - x) + size, 2 * (F.col("north") - F.col("row") * size - y) - size
    inside = cells.where(dx * dx + dy * dy <= 4 * r * r)
    return inside.groupBy("project", "row", "col").agg(F.bool_or("hard").alias("blocked"), (F.count_if(~F.col("hard")) * SOFT_WEIGHT).alias("added"))


def surface_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each project's surface that cost more than others, or are blocked."""
    return disc_cells(layers(spark, sf_dir), surfaces(spark, sf_dir))


def supercover(legs: DataFrame) -> DataFrame:
    """Cells (t, share, row, col) that straight legs (x1, y1, x2, y2 and their surface's columns) meet: at the points t of their
    way on lines of the grid, with no share of it, and in the middle of each stretch between two of these. Corners count, and
    along a line the cells on both sides; cells outside of the surface don't.
    """
    size = F.col("resolution_m")
    u = lambda i: (F.col(f"x{i}") - F.col("west")) / size
    v = lambda i: (F.col("north") - F.col(f"y{i}")) / size
    rows = legs.withColumns({"u1": u(1), "v1": v(1), "u2": u(2), "v2": v(2)})

    def lines(c: str) -> Column:
        a, b = F.col(f"{c}1"), F.col(f"{c}2")
        low, high = F.ceil(F.least(a, b)), F.floor(F.greatest(a, b))
        return F.when((a == b) | (low > high), F.array().cast("array<double>")).otherwise(F.transform(F.sequence(low, high), lambda k: (k - a) / (b - a)))

    inner = F.filter(F.concat(lines("u"), lines("v")), lambda t: (t > 0) & (t < 1))
    rows = rows.withColumn("stops", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), inner))))
    rows = rows.withColumn("stretch", F.explode(F.arrays_zip(F.col("stops").alias("a"), F.slice("stops", 2, F.size("stops")).alias("b"))))
    a, b = F.col("stretch.a"), F.col("stretch.b")
    at = lambda t, share: F.struct(t.alias("t"), share.alias("share"))
    middle = F.when(b.isNotNull(), at((a + b) / 2, b - a))
    rows = rows.withColumn("place", F.explode(F.array(at(a, F.lit(0.0)), middle))).where("place is not null").drop("stops", "stretch").select("*", "place.*")
    rows = rows.withColumns({"c": F.col("u1") + (F.col("u2") - F.col("u1")) * F.col("t"), "r": F.col("v1") + (F.col("v2") - F.col("v1")) * F.col("t")})
    sides = lambda c: [F.floor(F.col(c) - ON_LINE), F.floor(F.col(c) + ON_LINE)]
    cells = F.array_distinct(F.array(*[F.struct(r.alias("row"), c.alias("col")) for r in sides("r") for c in sides("c")]))
    rows = rows.withColumn("cell", F.explode(cells)).drop("u1", "v1", "u2", "v2", "c", "r", "place").select("*", "cell.*").drop("cell")
    return rows.where(F.col("row").between(0, F.col("height") - 1) & F.col("col").between(0, F.col("width") - 1))


def leg_costs(legs: DataFrame, raster: DataFrame, key: list[str]) -> DataFrame:
    """Cells that each leg meets and what it costs: its length times the dearest cell of each part; no cost if it meets a blocked
    cell or leaves the surface. ``key`` names a leg and holds its project.

    Legs are dealt out by their key once, which counts cells in place; the parts in cells of the raster meet it by cell.
    """
    legs = legs.repartition(int(legs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    inside = lambda c, side, size: ((F.col(c) - F.col(side)) * (1 if side == "west" else -1)).between(F.lit(0), F.col(size) * F.col("resolution_m"))
    whole = inside("x1", "west", "width") & inside("x2", "west", "width") & inside("y1", "north", "height") & inside("y2", "north", "height")
    length = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1")))
    parts = supercover(legs).select(*key, "t", "share", "row", "col")
    counted = parts.select(*key, "row", "col").distinct().groupBy(*key).agg(F.count("*").alias("n_cells"))
    met = parts.join(raster, ["project", "row", "col"]).groupBy(*key, "t").agg(F.max("share").alias("share"), F.max("added").alias("added"), F.bool_or("blocked").alias("blocked"))
    met = met.groupBy(*key).agg(F.sum(F.col("share") * F.col("added")).alias("more"), F.bool_or("blocked").alias("blocked"))
    rows = legs.select(*key, length.cast("double").alias("length"), whole.alias("whole")).join(counted, key, "left").join(met, key, "left")
    is_open = F.col("whole") & ~F.coalesce("blocked", F.lit(False))
    return rows.select(*key, F.coalesce("n_cells", F.lit(0)).alias("n_cells"), is_open.alias("is_open"), F.when(is_open, F.round(F.col("length") * (1 + F.coalesce("more", F.lit(0.0))), 3)).alias("cost"))


def segment_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that the straight line of each tree edge meets, whether it may be built there, and its cost."""
    on = surfaces(spark, sf_dir)
    return leg_costs(tree_edges(spark, sf_dir).join(on.where("accepted"), "project"), disc_cells(layers(spark, sf_dir), on), ["project", "feeder", "node"])


QUERIES = (surfaces, surface_raster, segment_costs)
