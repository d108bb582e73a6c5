"""Micro-siting of poles: intermediate poles move along their route to fewer owners, fewer parcels, better spans, in this order.

Routes of neighbouring feeders and the layers that their box meets come together in Arrow batches, where candidates are placed,
judged and moved; candidates never travel. A network's layout is accepted as a whole, by aggregates, only if it got better.
``standing_on`` and ``sited`` do the same for places and layers of any source, by joins.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from math import hypot

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.operators.catalogue import pick
from windloom.operators.layers import _outline, bent_route_poles, covering, polygons
from windloom.operators.network import MAX_SPAN, MIN_SPAN, TARGET_SPAN
from windloom.operators.routing import meeting, spread
from windloom.sources import bindings
from windloom.sources.lineage import cut

#: Search radius and spacing of candidates in millimetres, passes over a route, and what counts as better, in metres.
RADIUS, SPACING, PASSES, IMPROVEMENT = 15_000, 5_000, 2, 1.0
#: Feeders whose routes one task's group holds.
FEEDERS = 16
LAYOUT = "struct<owners:array<string>,parcels:array<long>,penalty:double>"
SITED = f"project int, poles array<struct<feeder:int,pole_id:string,kind:string,original:long,chosen:long>>, before {LAYOUT}, after {LAYOUT}"


def route_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legs of each feeder's line with the places where they begin and end along it, in millimetres."""
    order = Window.partitionBy("project", "feeder").orderBy("k")
    rows = bindings.turbines(spark, sf_dir).select("project", "feeder", "k", "x", "y").withColumns({"x1": F.lag("x").over(order), "y1": F.lag("y").over(order)})
    dx, dy = F.col("x") - F.col("x1"), F.col("y") - F.col("y1")
    legs = rows.withColumn("leg", F.coalesce(F.round(F.sqrt(dx * dx + dy * dy) * 1000).cast("long"), F.lit(0))).withColumn("to", F.sum("leg").over(order))
    return legs.where("leg > 0").select("project", "feeder", (F.col("to") - F.col("leg")).alias("from"), "to", "leg", "x1", "y1", F.col("x").alias("x2"), F.col("y").alias("y2"))


def at_chainage(places: DataFrame, legs: DataFrame) -> DataFrame:
    """Places (project, feeder, at) with the point (x, y in metres) on the route; those before its begin or beyond its end are left out."""
    on = (F.col("p.project") == F.col("l.project")) & (F.col("p.feeder") == F.col("l.feeder")) & (F.col("at") >= F.col("l.from")) & ((F.col("at") < F.col("l.to")) | ((F.col("at") == F.col("l.to")) & F.col("is_last")))
    last = legs.withColumn("is_last", F.col("to") == F.max("to").over(Window.partitionBy("project", "feeder")))
    share = (F.col("at") - F.col("l.from")) / F.col("leg")
    point = lambda c: F.round(F.col(f"{c}1") + share * (F.col(f"{c}2") - F.col(f"{c}1")), 3).alias(c)
    return places.alias("p").join(last.alias("l"), on).select("p.*", point("x"), point("y"))


def candidates(poles: DataFrame, radius: int = RADIUS, spacing: int = SPACING) -> DataFrame:
    """Poles (project, feeder, pole_id, at, kind) with each place they may take: ``original`` and ``at``; only intermediate ones may move."""
    steps = F.when(F.col("kind") == "intermediate", F.sequence(F.lit(-(radius // spacing)), F.lit(radius // spacing))).otherwise(F.array(F.lit(0)))
    rows = poles.withColumn("original", F.col("at")).withColumn("step", F.explode(steps))
    return rows.withColumn("at", F.col("original") + F.col("step") * spacing).drop("step")


def standing_on(places: DataFrame, parcels: DataFrame, owners: DataFrame, hard: DataFrame) -> DataFrame:
    """Places with the parcels they stand on (project, layer, ring, unavailable), the known owners (layer, owner), and whether a pole may stand there."""
    key = ["project", "feeder", "pole_id", "at"]
    points = places.select("project", F.struct(*key).alias("turbine_id"), "x", "y")
    both = parcels.select("project", "layer", "ring", F.lit(0).alias("buffer_m")).unionByName(hard.select("project", "layer", "ring", F.col("buffer_m").cast("int")))
    facts = parcels.select("layer", "unavailable", F.col("layer").alias("parcel")).join(owners, "layer", "left").unionByName(hard.select("layer", F.lit(True).alias("unavailable")), allowMissingColumns=True)
    land = covering(points, both).join(facts, "layer").groupBy(*[F.col(f"turbine_id.{c}").alias(c) for c in key])
    land = land.agg(F.array_sort(F.collect_set("parcel")).alias("parcels"), F.array_sort(F.collect_set("owner")).alias("owners"), F.bool_or("unavailable").alias("shut"))  # of one place
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).alias(f"n_{c}")
    return places.join(land, key, "left").select(*places.columns, "parcels", "owners", count("parcels"), count("owners"), (~F.coalesce("shut", F.lit(False))).alias("free"))


def descend(poles: list[np.ndarray], start: list[int], passes: int = PASSES, improvement: float = IMPROVEMENT, target: float = TARGET_SPAN, shortest: float = MIN_SPAN, longest: float = MAX_SPAN) -> list[int]:
    """The candidate taken by each pole of a route. A pole's candidates are rows (at, x, y, owners, parcels, free) in order; ``start`` names the original ones.

    Pole after pole takes the best candidate between its neighbours: fewer owners, then fewer parcels, then spans nearer to the
    target by more than ``improvement``, then the smaller move. Candidates belong to the original place, so no pole drifts away.
    """
    places, taken = [rows.tolist() for rows in poles], list(start)
    open_ = [len(rows) > 1 and any(row[5] for row in rows) for rows in places]
    for _ in range(passes):
        moved = False
        for k in range(1, len(places) - 1):
            if not open_[k]:
                continue
            before, after, original = places[k - 1][taken[k - 1]], places[k + 1][taken[k + 1]], places[k][start[k]][0]
            spans = [(hypot(x - before[1], y - before[2]), hypot(x - after[1], y - after[2])) for _, x, y, *_ in places[k]]
            worth = [(owners, parcels, abs(u - target) + abs(v - target), abs(at - original)) for (at, _, _, owners, parcels, _), (u, v) in zip(places[k], spans)]
            best = taken[k]
            for c, (at, _, _, _, _, free) in enumerate(places[k]):
                if free and before[0] < at < after[0] and all(shortest <= s <= longest for s in spans[c]):
                    gain, away = worth[best][2] - worth[c][2], worth[best][3] - worth[c][3]
                    if worth[c][:2] < worth[best][:2] or (worth[c][:2] == worth[best][:2] and (gain > improvement or (abs(gain) <= improvement and away > 0))):
                        best = c
            moved |= best != taken[k]
            taken[k] = best
        if not moved:
            break
    return taken


def _move(route: pd.DataFrame) -> pd.DataFrame:
    """Chosen and original place of each pole of one route."""
    route = route.sort_values(["original", "pole_id", "at"])
    names, rows = route["pole_id"].to_numpy(), route[["at", "x", "y", "n_owners", "n_parcels", "free"]].to_numpy(float)
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    ends = np.append(first[1:], len(rows))
    original = route["original"].to_numpy()
    taken = descend([rows[a:z] for a, z in zip(first, ends)], [int(np.flatnonzero(rows[a:z, 0] == original[a])[0]) for a, z in zip(first, ends)])
    return pd.DataFrame({"project": route["project"].iloc[0], "feeder": route["feeder"].iloc[0], "pole_id": names[first], "chosen": rows[first + np.array(taken), 0].astype(np.int64)})


def _objective(layout: DataFrame) -> DataFrame:
    """Owners, parcels and span penalty of each project's poles (project, feeder, pole_id, at, x, y, parcels, owners)."""
    order = Window.partitionBy("project", "feeder").orderBy("at", "pole_id")
    dx, dy = F.lead("x").over(order) - F.col("x"), F.lead("y").over(order) - F.col("y")
    span = layout.withColumn("penalty", F.abs(F.sqrt(dx * dx + dy * dy) - TARGET_SPAN)).groupBy("project").agg(F.round(F.sum("penalty"), 6).alias("penalty"))
    count = lambda c: layout.select("project", F.explode(c).alias("c")).groupBy("project").agg(F.count_distinct("c").alias(f"n_{c}"))
    found = span.join(count("owners"), "project", "left").join(count("parcels"), "project", "left")
    return found.select("project", F.struct(F.coalesce("n_owners", F.lit(0)).alias("owners"), F.coalesce("n_parcels", F.lit(0)).alias("parcels"), F.coalesce("penalty", F.lit(0.0)).alias("penalty")).alias("objective"))


def sited(places: DataFrame) -> DataFrame:
    """Poles with the place they take: project, feeder, pole_id, kind, original, at and whether the project's new layout was accepted. ``places`` as ``standing_on`` gives them."""
    schema = "project int, feeder int, pole_id string, chosen long"
    moves = places.select("project", "feeder", "pole_id", "original", "at", "x", "y", "n_owners", "n_parcels", "free").groupBy("project", "feeder").applyInPandas(_move, schema)
    key = ["project", "feeder", "pole_id"]
    new = cut(places.join(moves, key).where("at = chosen"))
    before, after = _objective(places.where("at = original")), _objective(new)
    better = before.join(after.withColumnRenamed("objective", "now"), "project").select("project", (F.col("now") < F.col("objective")).alias("accepted"))
    rows = new.join(better, "project")
    return rows.select(*key, "kind", "original", F.when(F.col("accepted"), F.col("chosen")).otherwise(F.col("original")).alias("at"), "accepted")


def half_up(values: np.ndarray, digits: int = 3) -> np.ndarray:
    """Values rounded as SQL rounds doubles: by their shortest decimal form, halves away from zero."""
    scaled = values * 10**digits
    whole = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        whole[i] = int(Decimal(repr(float(values[i]))).scaleb(digits).to_integral_value(ROUND_HALF_UP))
    return whole / 10**digits


def _placed(original: np.ndarray, moves: np.ndarray, legs: dict[str, np.ndarray]) -> np.ndarray:
    """Candidates (pole, at, x, y) of one route: those of ``candidates`` that ``at_chainage`` finds on it."""
    reach = RADIUS // SPACING
    count = np.where(moves, 2 * reach + 1, 1)
    pole = np.repeat(np.arange(len(original)), count)
    step = np.arange(len(pole)) - np.repeat(np.cumsum(count) - count, count) - np.where(moves, reach, 0)[pole]
    at = original[pole] + step * SPACING
    begin, to, leg, x1, y1, x2, y2 = (legs[c] for c in ("from", "to", "leg", "x1", "y1", "x2", "y2"))
    on = (at >= begin[0]) & (at <= to[-1])
    pole, at = pole[on], at[on]
    n = np.minimum(np.searchsorted(to, at, side="right"), len(to) - 1)
    share = (at - begin[n]) / leg[n]
    return np.column_stack([pole, at, half_up(x1[n] + share * (x2[n] - x1[n])), half_up(y1[n] + share * (y2[n] - y1[n]))])


class _Land:
    """Layers (ring, buffer_m) that points are tried against by the tests of ``_cover``, pairs at a time."""

    def __init__(self, layers: pa.Table):
        known = lambda ring, reach: ring and reach is not None and not any(p["x"] is None or p["y"] is None for p in ring)
        rows = [(k, _outline(ring), reach) for k, (ring, reach) in enumerate(zip(layers["ring"].to_pylist(), layers["buffer_m"].to_pylist())) if known(ring, reach)]
        self.rows, self.reach = np.array([r[0] for r in rows], int), np.array([r[2] for r in rows], np.int64)
        self.size = np.array([len(r[1]) for r in rows], int)
        self.edges = {n: np.stack([r[1] for r in rows if len(r[1]) == n]) for n in set(self.size.tolist())}
        self.place = np.zeros(len(rows), int)
        for n in self.edges:
            self.place[self.size == n] = np.arange((self.size == n).sum())
        ends = np.array([(r[1][:, :2].min(axis=0) - r[2], r[1][:, :2].max(axis=0) + r[2]) for r in rows]).reshape(-1, 4)
        self.west, self.south, self.east, self.north = ends.T

    def covers(self, x: np.ndarray, y: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the points and of ``some`` of the layers that cover them, as places in both."""
        layer, point = np.nonzero((x >= self.west[some, None]) & (x <= self.east[some, None]) & (y >= self.south[some, None]) & (y <= self.north[some, None]))
        found = np.zeros(len(layer), bool)
        for n, edges in self.edges.items():
            k = np.flatnonzero(self.size[some[layer]] == n)
            x1, y1, x2, y2 = np.moveaxis(edges[self.place[some[layer[k]]]], 2, 0)
            px, py, reach = x[point[k], None], y[point[k], None], self.reach[some[layer[k]], None]
            side = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
            odd = (((y1 > py) != (y2 > py)) & np.where(y2 > y1, side > 0, side < 0)).sum(axis=1) % 2 == 1
            dot, length = (px - x1) * (x2 - x1) + (py - y1) * (y2 - y1), (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
            to = lambda a, b: (px - a) * (px - a) + (py - b) * (py - b) <= reach * reach  # noqa: B023, E731
            close = np.where(dot <= 0, to(x1, y1), np.where(dot >= length, to(x2, y2), side * side <= reach * reach * length))
            found[k] = odd | close.any(axis=1)
        return point[found], layer[found]

    def shut(self, x: np.ndarray, y: np.ndarray, some: np.ndarray, most: int = 1_000_000) -> np.ndarray:
        """Whether any of the layers covers each point: a point that one covers isn't tried against the next ones."""
        found, left, k = np.zeros(len(x), bool), np.arange(len(x)), 0
        while len(left) and k < len(some):
            step = max(1, most // len(left))
            step = min(step, 32) if k == 0 else step
            found[left[self.covers(x[left], y[left], some[k : k + step])[0]]] = True
            left, k = left[~found[left]], k + step
        return found

    def touched(self, x: np.ndarray, y: np.ndarray, some: np.ndarray, most: int = 1_000_000) -> np.ndarray:
        """Those of the layers that cover any point: one that covers some isn't tried against the next ones, which are dealt all over."""
        order, left, k, step = np.random.default_rng(0).permutation(len(x)), some, 0, 64
        while len(left) and k < len(order):
            at = order[k : k + step]
            mark = np.zeros(len(left), bool)
            mark[self.covers(x[at], y[at], left)[1]] = True
            left, k = left[~mark], k + step
            step = max(1, min(2 * step, most // max(1, len(left))))
        return np.setdiff1d(some, left)


def _site(routes: pa.Table, layers: pa.Table) -> pa.Table:
    """Chosen places of the poles of some routes, and the owners, parcels and span penalty of their layout before and after, as one row.

    Parcels and owners are counted only where a pole may move to, and where it then stands.
    """
    routes = routes.take(pa.array(np.argsort(routes["feeder"].to_numpy(), kind="stable")))
    feeders, lists, lines = routes["feeder"].to_pylist(), routes["poles"].combine_chunks(), routes["legs"].combine_chunks()
    poles, flat = lists.flatten(), lines.flatten()
    originals, moves = poles.field("original").to_numpy(), pc.equal(poles.field("kind"), "intermediate").to_numpy(zero_copy_only=False)
    legs = {c: flat.field(c).to_numpy() for c in ("from", "to", "leg", "x1", "y1", "x2", "y2")}
    pole_ends, leg_ends = (np.cumsum([0, *np.diff(c.offsets.to_numpy())]) for c in (lists, lines))
    found = [_placed(originals[a:z], moves[a:z], {c: v[i:j] for c, v in legs.items()}) + [a, 0, 0, 0] for a, z, i, j in zip(pole_ends, pole_ends[1:], leg_ends, leg_ends[1:])]
    pole, at, x, y = np.concatenate(found).T
    pole, ends = pole.astype(int), np.cumsum([0, *[len(c) for c in found]])
    first = np.flatnonzero(np.diff(pole, prepend=-1))
    last, start = np.append(first[1:], len(pole)), np.flatnonzero(at == originals[pole])
    land, names, owners = _Land(layers), layers["layer"].to_numpy(), np.array(layers["owner"].to_pylist(), object)
    owner = pd.factorize(owners)[0]
    parcel = np.where(layers["is_parcel"].to_numpy(), np.unique(names, return_inverse=True)[1], -1)
    closed = pc.fill_null(layers["unavailable"], False).to_numpy()[land.rows]
    held = np.flatnonzero((parcel[land.rows] >= 0) | (owner[land.rows] >= 0))
    free = ~land.shut(x, y, np.flatnonzero(closed))
    own = np.repeat(np.arange(len(first)), last - first)  # the pole's place among those that have candidates
    other = free.copy()
    other[start] = False
    open_ = np.bincount(own[other], minlength=len(first)) > 0
    counts, wanted = np.zeros((len(at), 2)), np.flatnonzero(open_[own])
    wanted = wanted[free[wanted] | np.isin(wanted, start)]
    step = max(1, 1_000_000 // max(1, len(held)))
    for some in (wanted[k : k + step] for k in range(0, len(wanted), step)):
        point, layer = land.covers(x[some], y[some], held)
        for c, code in enumerate((owner[land.rows[held[layer]]], parcel[land.rows[held[layer]]])):
            pairs = np.unique(np.column_stack([point, code])[code >= 0], axis=0)
            counts[some, c] = np.bincount(pairs[:, 0], minlength=len(some))
    taken, penalty = start.copy(), {"before": 0.0, "after": 0.0}
    for a, z in zip(ends, ends[1:]):
        here = slice(*np.searchsorted(first, [a, z]))
        if open_[here].any():
            rows = np.column_stack([at[a:z], x[a:z], y[a:z], counts[a:z], free[a:z]])
            taken[here] = first[here] + descend([rows[i - a : j - a] for i, j in zip(first[here], last[here])], (start[here] - first[here]).tolist())
        for layout, places in (("before", start[here]), ("after", taken[here])):
            penalty[layout] += float(np.abs(np.hypot(np.diff(x[places]), np.diff(y[places])) - TARGET_SPAN).sum())
    covered = {"before": land.rows[land.touched(x[start], y[start], held)]}
    covered["after"] = covered["before"] if (taken == start).all() else land.rows[land.touched(x[taken], y[taken], held)]
    parcels = {k: np.unique(names[v[parcel[v] >= 0]]).tolist() for k, v in covered.items()}
    known = {k: sorted(set(owners[v[owner[v] >= 0]].tolist())) for k, v in covered.items()}
    of = pa.array(np.repeat(feeders, np.diff(pole_ends))[pole[first]], pa.int32())
    out = poles.take(pa.array(pole[first]))
    rows = pa.StructArray.from_arrays([of, *[out.field(c) for c in ("pole_id", "kind", "original")], pa.array(at[taken].astype(np.int64))], names=["feeder", "pole_id", "kind", "original", "chosen"])
    layout_type = pa.struct([("owners", pa.list_(pa.string())), ("parcels", pa.list_(pa.int64())), ("penalty", pa.float64())])
    layouts = {k: pa.array([{"owners": known[k], "parcels": parcels[k], "penalty": penalty[k]}], layout_type) for k in ("before", "after")}
    return pa.table({"project": routes["project"][:1], "poles": pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), **layouts})


def sited_routes(poles: DataFrame, legs: DataFrame, parcels: DataFrame, owners: DataFrame, hard: DataFrame) -> DataFrame:
    """``sited`` for the poles and legs of routes: feeders of one share and the layers their box meets are one group, whatever the size of a project."""
    key, share = ["project", "feeder"], F.floor(F.col("feeder") / FEEDERS).alias("share")
    routes = poles.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("original"), "pole_id", "kind"))).alias("poles"))  # of one feeder
    routes = routes.join(legs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("from", "to", "leg", "x1", "y1", "x2", "y2"))).alias("legs")), key).select("*", share)
    box = legs.groupBy("project", share).agg(*[g(f(f"{c}1"), f(f"{c}2")).alias(n) for n, c, f, g in (("w", "x", F.min, F.least), ("e", "x", F.max, F.greatest), ("s", "y", F.min, F.least), ("n", "y", F.max, F.greatest))])
    layers = parcels.join(owners, "layer", "left").select("project", "layer", "ring", F.lit(0).alias("buffer_m"), F.lit(True).alias("is_parcel"), "unavailable", "owner")
    layers = layers.unionByName(hard.select("project", "layer", "ring", F.col("buffer_m").cast("int"), F.lit(False).alias("is_parcel"), F.lit(True).alias("unavailable"), F.lit(None).cast("string").alias("owner")))
    end = lambda f, c, s: f(F.transform("ring", lambda p: p[c])) + s * F.col("buffer_m")
    here, there = spread(box, "a", F.col("w"), F.col("e"), F.col("s"), F.col("n")), spread(layers, "b", end(F.array_min, "x", -1), end(F.array_max, "x", 1), end(F.array_min, "y", -1), end(F.array_max, "y", 1))
    met = meeting(here, there).select(F.col("project").alias("in_project"), F.col("share").alias("in_share"), "layer", "ring", "buffer_m", "is_parcel", "unavailable", "owner")
    n = 4 * int(poles.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as few bytes stand for much work here and would be put together
    routes, met = routes.repartition(n, "project", "share"), met.repartition(n, "in_project", "in_share")
    found = cut(routes.groupBy("project", "share").cogroup(met.groupBy("in_project", "in_share")).applyInArrow(_site, SITED))

    def objective(layout: str) -> DataFrame:
        count = lambda c: found.select("project", F.explode(f"{layout}.{c}").alias("c")).groupBy("project").agg(F.count_distinct("c").alias(f"n_{c}"))
        total = found.groupBy("project").agg(F.round(F.sum(f"{layout}.penalty"), 6).alias("penalty")).join(count("owners"), "project", "left").join(count("parcels"), "project", "left")
        return total.select("project", F.struct(F.coalesce("n_owners", F.lit(0)), F.coalesce("n_parcels", F.lit(0)), "penalty").alias(layout))

    better = objective("before").join(objective("after"), "project").select("project", (F.col("after") < F.col("before")).alias("accepted"))
    rows = found.select("project", F.explode("poles").alias("p")).select("project", "p.*").join(F.broadcast(better), "project")
    return rows.select("project", "feeder", "pole_id", "kind", "original", F.when(F.col("accepted"), F.col("chosen")).otherwise(F.col("original")).alias("at"), "accepted")


def micro_siting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each pole of each feeder's line stands after micro-siting. Soft layers stand for parcels, every sixth of them unavailable."""
    k = F.col("layer")
    layers = polygons(spark, sf_dir)
    parcels = layers.where("not is_hard").select("project", "layer", "ring", (k % 6 == 0).alias("unavailable"))
    owners = parcels.where(k % 5 != 0).select("layer", F.concat(pick(["A", "B", "C"], k % 3), (k % 40).cast("string")).alias("owner"))
    return sited_routes(bent_route_poles(spark, sf_dir), route_legs(spark, sf_dir), parcels, owners, layers.where("is_hard").select("project", "layer", "ring", "buffer_m"))


QUERIES = (micro_siting,)
