"""Validity of rings and their repair: contacts of edges found by cells, the enclosed area cut into pieces that are valid.

What lies inside follows the even-odd rule, as cutting a ring at its crossings gives it: an area that a ring goes round twice
is outside. A repaired ring is the set of its pieces (trapezoids between heights), which meet along edges and never overlap.
Coordinates are whole metres, so that contacts are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.operators.layers import polygons

#: Cells by which edges meet, and bands of height that are cut apart, in metres.
CELL, BAND = 500, 500


def clean_edges(rings: DataFrame, by: list[str]) -> DataFrame:
    """Edges (i, n, x1, y1, x2, y2) of rings, repeats of the point before and a closing point left out; rings with an unknown
    coordinate or of fewer than three different points have none.
    """
    known = F.coalesce(F.forall("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull()), F.lit(False)) & (F.size(F.array_distinct("ring")) > 2)
    size = F.size("ring")
    moves = F.filter(F.transform("ring", lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), (p == F.get("ring", F.pmod(i - 1, size))).alias("stays"))), lambda p: ~p["stays"])
    rows = rings.where(known).select(*by, moves.alias("ring")).withColumn("n", F.size("ring"))
    after = lambda i: F.get("ring", (i + 1) % F.size("ring"))
    edges = F.transform("ring", lambda p, i: F.struct(i.alias("i"), p["x"].cast("long").alias("x1"), p["y"].cast("long").alias("y1"), after(i)["x"].cast("long").alias("x2"), after(i)["y"].cast("long").alias("y2")))
    return rows.select(*by, "n", F.explode(edges).alias("e")).select(*by, "n", "e.*")


def _side(a: str, b: str, p: str) -> Column:
    """Sign of the turn from a over b to p, points named by the ends of their columns."""
    c = lambda v, q: F.col(f"{v}{q}")
    return F.signum((c("x", b) - c("x", a)) * (c("y", p) - c("y", a)) - (c("y", b) - c("y", a)) * (c("x", p) - c("x", a)))


def contacts(edges: DataFrame, by: list[str], size: int = CELL) -> DataFrame:
    """Pairs of edges (i, j) of a ring that share a point they shouldn't, and the height ``y`` of a crossing (NULL if parallel).

    Neighbours share their common point, and may not fold back; others may not touch. Edges meet by cells, and a pair counts once.
    """
    span = lambda c: F.sequence(F.floor(F.least(f"{c}1", f"{c}2") / size), F.floor(F.greatest(f"{c}1", f"{c}2") / size))
    placed = edges.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    other = placed.withColumnsRenamed({"i": "j", "x1": "x3", "y1": "y3", "x2": "x4", "y2": "y4"}).drop("n")
    pairs = placed.join(other, [*by, "cx", "cy"]).where("i < j").drop("cx", "cy").distinct()
    overlap = lambda c: (F.least(f"{c}1", f"{c}2") <= F.greatest(f"{c}3", f"{c}4")) & (F.least(f"{c}3", f"{c}4") <= F.greatest(f"{c}1", f"{c}2"))
    meet = overlap("x") & overlap("y") & (_side("1", "2", "3") * _side("1", "2", "4") <= 0) & (_side("3", "4", "1") * _side("3", "4", "2") <= 0)
    cross = (F.col("x2") - F.col("x1")) * (F.col("y4") - F.col("y3")) - (F.col("y2") - F.col("y1")) * (F.col("x4") - F.col("x3"))
    ahead = (F.col("x2") - F.col("x1")) * (F.col("x4") - F.col("x3")) + (F.col("y2") - F.col("y1")) * (F.col("y4") - F.col("y3"))
    follows = (F.col("j") == F.col("i") + 1) | ((F.col("i") == 0) & (F.col("j") == F.col("n") - 1))
    wrong = F.when(follows, (cross == 0) & (ahead < 0)).otherwise(meet)
    way = ((F.col("x3") - F.col("x1")) * (F.col("y4") - F.col("y3")) - (F.col("y3") - F.col("y1")) * (F.col("x4") - F.col("x3"))).cast("double") / cross
    return pairs.where(wrong).select(*by, "i", "j", F.when(cross != 0, F.col("y1") + way * (F.col("y2") - F.col("y1"))).alias("y"))


def pieces(edges: DataFrame, touches: DataFrame, by: list[str], band: int = BAND) -> DataFrame:
    """Trapezoids (low, high, and the left and right ends at both heights) that make up what the rings enclose by the even-odd rule.

    A ring is cut into bands, so that a tall one spreads over tasks; a band is cut at each height where an edge ends or crosses.
    """
    y1, y2 = F.least("y1", "y2").cast("double"), F.greatest("y1", "y2").cast("double")
    slanted = edges.where("y1 <> y2").withColumns({"low": y1, "high": y2}).withColumn("band", F.explode(F.sequence(F.floor(F.col("low") / band), F.ceil(F.col("high") / band) - 1)))
    lines = F.array(F.greatest("low", (F.col("band") * band).cast("double")), F.least("high", ((F.col("band") + 1) * band).cast("double")))
    heights = slanted.select(*by, "band", F.explode(lines).alias("y")).unionByName(touches.where("y is not null").select(*by, F.floor(F.col("y") / band).alias("band"), "y")).distinct()
    slabs = heights.withColumn("top", F.lead("y").over(Window.partitionBy(*by, "band").orderBy("y"))).where("top is not null").withColumnRenamed("y", "bottom")
    inside = slanted.join(slabs, [*by, "band"]).where("low <= bottom and high >= top")
    at = lambda y: F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    rows = inside.select(*by, "bottom", "top", "i", at(F.col("bottom")).alias("a"), at(F.col("top")).alias("b"), at((F.col("bottom") + F.col("top")) / 2).alias("middle"))
    order = Window.partitionBy(*by, "bottom").orderBy("middle", "i")
    rows = rows.withColumns({"k": F.row_number().over(order), "right_low": F.lead("a").over(order), "right_high": F.lead("b").over(order), "width": F.lead("middle").over(order) - F.col("middle")})
    return rows.where("k % 2 = 1 and width > 0").select(*by, F.col("bottom").alias("low"), F.col("top").alias("high"), F.col("a").alias("left_low"), F.col("b").alias("left_high"), "right_low", "right_high", ((F.col("top") - F.col("bottom")) * F.col("width")).alias("area"))


def checked(rings: DataFrame, by: list[str]) -> DataFrame:
    """State of each ring (keyed by ``by``, points in ``ring``), wrong contacts and area after repair.

    VALID; REPAIRED (edges met, the area is that of its pieces); rejected, without an area: NOT_KNOWN (a ring or coordinate is
    NULL), TOO_FEW_POINTS (fewer than three different ones), NO_AREA (none to a millionth of a square metre: points in one line
    leave slivers of rounding). Keys must be there and name one ring each.
    """
    edges = clean_edges(rings, by)
    touches = contacts(edges, by)
    found = touches.groupBy(*by).agg(F.count("*").alias("n_contacts"))
    area = pieces(edges, touches, by).groupBy(*by).agg(F.sum("area").alias("area"))
    known = F.coalesce(F.forall("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull()), F.lit(False))
    rows = rings.select(*by, known.alias("known"), F.size(F.array_distinct("ring")).alias("points")).join(found, by, "left").join(area, by, "left")
    state = F.when(~F.col("known"), "NOT_KNOWN").when(F.col("points") < 3, "TOO_FEW_POINTS").when(F.coalesce(F.round("area", 6), F.lit(0.0)) <= 0, "NO_AREA").when(F.col("n_contacts") > 0, "REPAIRED").otherwise("VALID")
    return rows.select(*by, state.alias("state"), F.coalesce("n_contacts", F.lit(0)).alias("n_contacts"), F.when(F.round("area", 6) > 0, F.round("area", 2)).alias("area_m2"))


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings as surveyors draw them (test binding): some cross themselves, fold back, touch, repeat points or have none to speak of."""
    k, p = F.col("layer"), [F.get("ring", F.lit(i)) for i in range(5)]
    a, b, c, d, e = p
    forms = {7: F.array(a, c, b, e), 6: F.array(a, b, b, c, d, e, a), 5: F.array(a, d, c, e, b), 4: F.array(a, b, c, b, e), 3: F.array(a, b, d, c, e, d), 2: F.array(a, c, a), 1: F.array(a, d, c), 8: F.array(a, b, c, e, a, b, c, d)}
    shape = F.col("ring")
    for rest, form in forms.items():
        shape = F.when(k % 11 == rest, form).otherwise(shape)
    return polygons(spark, sf_dir).select("project", "layer", shape.alias("ring"))


def ring_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity, contacts and area after repair of each drawn ring."""
    return checked(drawn(spark, sf_dir), ["project", "layer"])


QUERIES = (ring_validity,)
