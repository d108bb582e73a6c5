"""Turbines into feeders under a capacity, and a beam search over changed groupings.

A request is a whole project of up to SITE turbines, the reference's limit of a planning request; a larger project is split
into neighbours in the order of x, y, id. Each request is one group, so groups are bounded.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.sources import bindings

#: Turbines of a request and capacity of a feeder in kW.
SITE, CAPACITY = 500, 36000
#: Rounds, states kept and changes tried for each state.
ROUNDS, BEAM, NEIGHBOURS = 2, 3, 5
#: Turbines whose exchanges are priced at once.
STRIP = 25
#: The groupings of a request.
STATES = "array<struct<cost:double,label:array<int>>>"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with their turbines as an array in the order of x, y, id; partitions by a named number, so that Spark doesn't put them together."""
    t = bindings.turbines(spark, sf_dir)
    site = F.floor((F.col("feeder") * 10 + F.col("k") - 1) / SITE).cast("int")
    rows = t.select("project", site.alias("site"), F.struct("x", "y", "turbine_id", "kw").alias("t"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "project", "site").groupBy("project", "site").agg(F.sort_array(F.collect_list("t")).alias("turbines"))


def cost_of(xy: np.ndarray, label: np.ndarray) -> float:
    """Summed squared distance of the turbines to their feeder's centroid, in square kilometres."""
    return sum(float(((xy[label == j] - xy[label == j].mean(axis=0)) ** 2).sum()) for j in np.unique(label)) / 1e6


def spread_seeds(xy: np.ndarray, k: int) -> np.ndarray:
    """First the turbine nearest to the middle, then always the one farthest from all seeds; ties to the first."""
    seeds = [int(((xy - xy.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    near = np.full(len(xy), np.inf)
    while len(seeds) < k:
        near = np.minimum(near, ((xy - xy[seeds[-1]]) ** 2).sum(axis=1))
        seeds.append(int(near.argmax()))
    return xy[seeds]


def assign(xy: np.ndarray, kw: np.ndarray, centres: np.ndarray) -> np.ndarray | None:
    """Each turbine to the nearest centre with room, those with most to lose first; None if one fits nowhere."""
    d = ((xy[:, None] - centres[None]) ** 2).sum(axis=2)
    near = np.sort(d, axis=1)
    loss = near[:, min(1, d.shape[1] - 1)] - near[:, 0]
    room, label = np.full(len(centres), float(CAPACITY)), np.full(len(xy), -1)
    for i in np.lexsort((np.arange(len(xy)), -loss, -kw)):
        fits = np.where(room >= kw[i], d[i], np.inf)
        j = int(fits.argmin())
        if fits[j] == np.inf:
            return None
        label[i] = j
        room[j] -= kw[i]
    return label


def group(xy: np.ndarray, kw: np.ndarray) -> np.ndarray:
    """Labels of the fewest feeders for which an assignment is found, centres moved to their turbines until nothing changes."""
    for k in range(max(1, math.ceil(kw.sum() / CAPACITY)), len(xy) + 1):
        centres, best, least = spread_seeds(xy, k), None, math.inf
        for _ in range(20):
            label = assign(xy, kw, centres)
            if label is None or (cost := cost_of(xy, label)) >= least - 1e-12:
                break
            best, least = label, cost
            centres = np.array([xy[label == j].mean(axis=0) if (label == j).any() else centres[j] for j in range(k)])
        if best is not None:
            used = sorted(np.unique(best), key=lambda j: tuple(xy[best == j].mean(axis=0)))
            return np.array([used.index(j) for j in best])
    raise ValueError("a turbine exceeds the capacity of a feeder")


def changes(xy: np.ndarray, kw: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """The cheapest moves and exchanges that keep all feeders within capacity.

    A feeder's share of the cost is its summed squares less the square of its sum over its size, so a change is priced from sums.
    """
    xy, k, n = xy - xy.mean(axis=0), int(label.max()) + 1, len(xy)
    load, size = np.bincount(label, weights=kw), np.bincount(label)
    (x, y), (tx, ty) = xy.T.copy(), np.array([xy[label == j].sum(axis=0) for j in range(k)]).T.copy()
    part = lambda sx, sy, n: (sx * sx + sy * sy) / np.maximum(n, 1)
    held, price = part(tx, ty, size), np.empty(n * k + n * n)
    move, swap = price[: n * k].reshape(n, k), price[n * k :].reshape(n, n)
    for a in range(0, n, STRIP):  # strips of turbines, so that what is worked out stays in the processor's cache
        i = slice(a, a + STRIP)
        own = label[i, None]
        move[i] = held[label[i]][:, None] + held[None] - part(tx[label[i]] - x[i], ty[label[i]] - y[i], size[label[i]] - 1)[:, None] - part(tx[None] + x[i, None], ty[None] + y[i, None], size[None] + 1)
        move[i][(load[None] + kw[i, None] > CAPACITY) | (own == np.arange(k))] = np.inf
        dx, dy, watts = x[None] - x[i, None], y[None] - y[i, None], kw[None] - kw[i, None]  # what the first one's feeder gains
        swap[i] = held[own] + held[label][None] - part(tx[own] + dx, ty[own] + dy, size[own]) - part(tx[label][None] - dx, ty[label][None] - dy, size[label][None])
        swap[i][(own >= label[None]) | (load[own] + watts > CAPACITY) | (load[label][None] - watts > CAPACITY)] = np.inf
    np.round(price, 3, out=price)
    found, few = [], min(NEIGHBOURS, len(price)) - 1
    near = np.flatnonzero(price <= np.partition(price, few)[few])  # the cheapest and all that equal the last of them, in their order
    for at in near[np.argsort(price[near], kind="stable")][:NEIGHBOURS]:
        if np.isinf(price[at]):
            break
        new = label.copy()
        if at < move.size:
            new[at // k] = at % k
        else:
            i, o = divmod(at - move.size, n)
            new[i], new[o] = label[o], label[i]
        found.append(new)
    return found


def _points(r) -> tuple[np.ndarray, np.ndarray]:
    return np.column_stack([r.x, r.y]).astype(float), np.asarray(r.kw, float)


def _mapped(work: DataFrame, name: str, kind: str, of) -> DataFrame:
    """The requests with one more column: what ``of`` gives for each."""

    def run(batches):
        for batch in batches:
            yield batch.assign(**{name: [of(r) for r in batch.itertuples(index=False)]})

    return work.mapInPandas(run, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in work.schema.fields], f"{name} {kind}"]))


def first_states(work: DataFrame) -> DataFrame:
    """Requests as arrays, each with its first grouping as its only state."""

    def start(r):
        xy, kw = _points(r)
        label = group(xy, kw)
        return [{"cost": round(cost_of(xy, label), 6), "label": label.tolist()}]

    arrays = work.select("project", "site", *[F.col(f"turbines.{c}").cast("array<long>").alias(c) for c in ("turbine_id", "x", "y", "kw")])
    return _mapped(arrays, "states", STATES, start)


def capacity_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeder of each turbine, feeders numbered by their centroids."""
    both = first_states(requests(spark, sf_dir)).withColumn("label", F.col("states")[0]["label"])
    rows = both.select("project", "site", F.explode(F.arrays_zip("turbine_id", "kw", "label")).alias("z"))
    return rows.select("project", "site", F.col("z.turbine_id").alias("turbine_id"), F.col("z.label").alias("feeder"), F.col("z.kw").alias("kw"))


def beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best grouping of each request after two rounds of changes: equal groupings are tried once, the three cheapest go on.

    A request and its states are one row, so that a round shuffles nothing and no round works out another one again. What was
    changed in an earlier round isn't changed again: its changes were better than the states kept then, or were cut by them.
    """

    def expand(r):
        xy, kw = _points(r)
        found = [m for s in r.fresh for m in changes(xy, kw, np.array(s["label"]))]
        return [{"cost": round(cost_of(xy, m), 6), "label": m.tolist()} for m in found]

    rows = first_states(requests(spark, sf_dir)).withColumn("first_cost", F.col("states")[0]["cost"]).withColumn("fresh", F.col("states"))
    for _ in range(ROUNDS):
        tried = _mapped(rows, "tried", STATES, expand)
        pool = tried.withColumn("pool", F.slice(F.array_sort(F.array_distinct(F.concat("states", "tried"))), 1, BEAM))
        rows = pool.withColumn("fresh", F.array_except("pool", "states")).withColumn("states", F.col("pool")).drop("tried", "pool")
    best = F.col("states")[0]
    return rows.select("project", "site", "first_cost", best["cost"].alias("best_cost"), best["label"].alias("label"))


QUERIES = (capacity_grouping, beam_search)
