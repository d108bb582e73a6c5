"""Turbines into the fewest feeders that hold them, by exact search on small sites: least distance, or most even counts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.operators.grouping import spread_seeds
from windloom.sources import bindings

#: Capacity of a feeder in kW (test binding: three to four turbines), and the rounds in which centres move.
CAPACITY, MOVES = 12_000, 50


def centres_of(xy: np.ndarray, k: int) -> np.ndarray:
    """Centres moved to the mean of the turbines nearest to them until none moves; an empty one stays."""
    centres = spread_seeds(xy, k).astype(float)
    for _ in range(MOVES):
        near = ((xy[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([xy[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(k)])
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def fits(load: list[int]) -> Callable[[int, list[int]], bool]:
    """Whether the rows from some place on fit into the rooms left; rooms that differ by their order are looked up, not tried again."""
    known: dict[tuple[int, ...], bool] = {}

    def fit(at: int, room: list[int]) -> bool:
        if at == len(load):
            return True
        left = sorted(room)
        key = (at, *left)
        if key not in known:
            known[key] = any(left[j] >= load[at] and (j == 0 or left[j] > left[j - 1]) and fit(at + 1, [*left[:j], left[j] - load[at], *left[j + 1 :]]) for j in range(len(left)))
        return known[key]

    return fit


def least_cost(cost: np.ndarray, load: np.ndarray, capacity: int) -> list[int] | None:
    """Group of each row with the least summed cost under the capacity; None if the rows don't fit.

    Rows are settled in the order of their load; a branch ends where the rest doesn't fit, or where even the cheapest groups
    for the rest can't beat the best.
    """
    n, k = cost.shape
    order = np.lexsort((np.arange(n), -load))
    loads, costs = load[order].tolist(), cost[order].tolist()
    cheapest = np.argsort(cost[order], axis=1, kind="stable").tolist()
    rest = [*np.cumsum(cost.min(axis=1)[order][::-1])[::-1].tolist(), 0.0]
    fit, best, found = fits(loads), float("inf"), None
    label, room = [0] * n, [int(capacity)] * k

    def settle(at: int, spent: float) -> None:
        nonlocal best, found
        if at == n:
            best, found = spent, label.copy()
            return
        if not fit(at, room):
            return
        need, row = loads[at], costs[at]
        for j in cheapest[at]:
            if spent + row[j] + rest[at + 1] >= best - 1e-9:
                break  # the groups that follow cost no less
            if room[j] >= need:
                room[j] -= need
                label[at] = j
                settle(at + 1, spent + row[j])
                room[j] += need

    settle(0, 0.0)
    return None if found is None else [found[i] for i in np.argsort(order).tolist()]


def most_even(load: np.ndarray, k: int, capacity: int) -> list[int] | None:
    """Group of each row so that the count farthest from n / k is as near to it as the capacity allows; None if the rows don't fit."""
    n = len(load)
    order = np.lexsort((np.arange(n), -load)).tolist()
    away = lambda counts: max(abs(c - n / k) for c in counts)
    best: tuple[float, list[int] | None] = (float("inf"), None)
    floor = away([n // k + (j < n % k) for j in range(k)])
    label, room, counts = [0] * n, [int(capacity)] * k, [0] * k

    def settle(at: int) -> None:
        nonlocal best
        if best[0] <= floor + 1e-9 or max(c - n / k for c in counts) >= best[0] - 1e-9:
            return
        if at == n:
            if away(counts) < best[0] - 1e-9:
                best = (away(counts), label.copy())
            return
        i, tried = order[at], set()
        for j in sorted(range(k), key=lambda j: (counts[j], j)):
            if room[j] >= load[i] and (room[j], counts[j]) not in tried:  # groups alike so far needn't be tried twice
                tried.add((room[j], counts[j]))
                room[j] -= int(load[i])
                counts[j] += 1
                label[i] = j
                settle(at + 1)
                room[j] += int(load[i])
                counts[j] -= 1

    settle(0)
    return best[1]


def fewest(xy: np.ndarray, load: np.ndarray, capacity: int, balance: bool) -> list[int] | None:
    """The assignment to the least number of groups that has one; None if a turbine alone is too large."""
    for k in range(max(1, -(-int(load.sum()) // capacity)), len(load) + 1):
        if balance:
            label = most_even(load, k, capacity)
        else:
            label = least_cost(((xy[:, None] - centres_of(xy, k)[None]) ** 2).sum(axis=2), load, capacity)
        if label is not None:
            return label
    return None


def numbered(xy: np.ndarray, label: list[int]) -> np.ndarray:
    """Groups numbered from 1 in the order of their centroids."""
    label = np.array(label)
    used = sorted(np.unique(label).tolist(), key=lambda j: tuple(xy[label == j].mean(axis=0)))
    return np.array([used.index(j) + 1 for j in label.tolist()])


def exact_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeders of each site of up to ten turbines under both objectives; NULL where a site has no assignment.

    A site is one row of arrays, dealt by a named number so that Spark doesn't put partitions together.
    """

    def group(r) -> list[list[str] | None]:
        xy, load = np.column_stack([r.x, r.y]).astype(float), np.asarray(r.kw)
        found = [fewest(xy, load, CAPACITY, balance) for balance in (False, True)]
        return [None if label is None else [f"F{j}" for j in numbered(xy, label)] for label in found]

    def run(batches):
        for batch in batches:
            names = [group(r) for r in batch.itertuples(index=False)]
            yield batch[["project", "site", "turbine_id"]].assign(by_distance=[d for d, _ in names], by_balance=[b for _, b in names])

    rows = bindings.turbines(spark, sf_dir).select("project", F.col("feeder").alias("site"), F.struct("x", "y", "turbine_id", "kw").alias("t"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sites = rows.repartition(n, "project", "site").groupBy("project", "site").agg(F.sort_array(F.collect_list("t")).alias("t"))  # ten turbines a site
    arrays = sites.select("project", "site", *[F.col(f"t.{c}").cast("array<long>").alias(c) for c in ("turbine_id", "x", "y", "kw")])
    named = arrays.mapInPandas(run, "project int, site int, turbine_id array<long>, by_distance array<string>, by_balance array<string>")
    each = named.select("project", "site", F.posexplode("turbine_id").alias("at", "turbine_id"), "by_distance", "by_balance")
    return each.select("project", "site", "turbine_id", *[F.get(c, F.col("at")).alias(c) for c in ("by_distance", "by_balance")])


QUERIES = (exact_grouping,)
