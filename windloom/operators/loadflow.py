"""AC load flow of radial feeders by backward and forward sweeps, and the repair of overloaded or badly regulated ones.

A feeder is a row with its nodes as an array (at most ten in a tree), so feeders spread evenly over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.operators.network import KV, POWER_FACTOR, feeder_tree

#: Ampacity, ohms per km (resistance, reactance) and nF per km of the catalogue, in ascending ampacity.
CATALOGUE = np.array([(100, 0.55, 0.40, 9.0), (160, 0.32, 0.38, 9.3), (240, 0.20, 0.36, 9.6), (330, 0.13, 0.34, 9.9), (430, 0.09, 0.33, 10.2), (600, 0.06, 0.31, 10.5), (900, 0.04, 0.16, 21.0), (1400, 0.02, 0.08, 42.0)])
#: Band of the voltage per unit, frequency, greatest number of repairs.
LOW, HIGH, HERTZ, MAX_REPAIRS = 0.95, 1.05, 50.0, 20
ROUNDS, CONVERGED = 100, 1e-9
ROOT = 10000.0


def sweep(parent: np.ndarray, power: np.ndarray, z: np.ndarray, y: np.ndarray, source: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Voltages (volts, phase to phase) and currents of each node's incoming edge (ampere, towards the node).

    ``parent`` is -1 for nodes at the substation and otherwise less than the node's own index; ``power`` is fed in, in VA; half
    of an edge's admittance ``y`` stands at either end. The last result says whether voltages settled.
    """
    v = np.full(len(parent), source, complex)
    flow = np.zeros(len(parent), complex)
    for _ in range(ROUNDS):
        inject = -np.conj(power / (3**0.5 * v)) + y / 2 * v / 3**0.5
        shunt = np.zeros(len(parent), complex)
        np.add.at(shunt, parent[parent >= 0], y[parent >= 0] / 2)
        inject = inject + shunt * v / 3**0.5
        flow = inject.copy()
        for i in range(len(parent) - 1, -1, -1):
            if parent[i] >= 0:
                flow[parent[i]] += flow[i]
        old = v.copy()
        for i in range(len(parent)):
            v[i] = (source if parent[i] < 0 else v[parent[i]]) - 3**0.5 * z[i] * flow[i]
        if not np.isfinite(v).all() or abs(v).min() < 0.1 * source:
            return v, flow, False
        if abs(v - old).max() < CONVERGED * source:
            return v, flow, True
    return v, flow, False


def solve(parent: np.ndarray, kw: np.ndarray, km: np.ndarray, cable: np.ndarray) -> dict:
    """Load flow with one catalogue cable an edge: per-unit voltages, currents, loss and whether it converged."""
    amp, r, x, c = CATALOGUE[cable].T
    z, y = (r + 1j * x) * km, 1j * 2 * np.pi * HERTZ * c * 1e-9 * km
    power = kw * 1000.0 * (1 - 1j * np.tan(np.arccos(POWER_FACTOR)))
    v, flow, ok = sweep(parent, power, z, y, KV * 1000.0)
    return {"pu": abs(v) / (KV * 1000), "loading": abs(flow) / amp, "amps": abs(flow), "drop": abs(z * flow), "loss_kw": float((3 * r * km * abs(flow) ** 2).sum() / 1000), "ok": ok}


def smallest(parent: np.ndarray, kw: np.ndarray) -> np.ndarray:
    """First cable that carries the power below each edge; the largest where none does."""
    load = kw.astype(float).copy()
    for i in range(len(parent) - 1, -1, -1):
        if parent[i] >= 0:
            load[parent[i]] += load[i]
    return np.minimum(np.searchsorted(CATALOGUE[:, 0], load / (3**0.5 * KV * POWER_FACTOR) - 1e-6), len(CATALOGUE) - 1)


def repair(parent: np.ndarray, kw: np.ndarray, km: np.ndarray) -> tuple[np.ndarray, dict, int, str]:
    """Larger cables where the flow asks for them: first every overloaded edge, else the edge of the worst node's path with the largest drop."""
    cable, top = smallest(parent, kw), len(CATALOGUE) - 1
    for n in range(MAX_REPAIRS + 1):
        got = solve(parent, kw, km, cable)
        if not got["ok"]:
            return cable, got, n, "NOT_CONVERGED"
        over = got["loading"] > 1
        outside = np.maximum(LOW - got["pu"], got["pu"] - HIGH)
        if not over.any() and outside.max() <= 1e-9:
            return cable, got, n, "REPAIRED" if n else "VALID"
        if over.any():
            change = over & (cable < top)
        else:
            path, i = [], int(outside.argmax())
            while i >= 0:
                path.append(i)
                i = int(parent[i])
            open_ = [i for i in path if cable[i] < top]
            change = np.zeros(len(parent), bool)
            if open_:
                change[max(open_, key=lambda i: (got["drop"][i], -i))] = True
        if not change.any():
            return cable, got, n, "NO_LARGER_CABLE"
        if n < MAX_REPAIRS:
            cable = cable + change
    return cable, got, MAX_REPAIRS, "ROUNDS_EXHAUSTED"


def _feeders(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = feeder_tree(spark, sf_dir).select("project", "feeder", F.struct("node", "parent", "kw", "x", "y").alias("n"))
    return nodes.groupBy("project", "feeder").agg(F.sort_array(F.collect_list("n")).alias("nodes"))  # ten nodes at most


def _arrays(nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = {int(n["node"]): i for i, n in enumerate(nodes)}
    parent = np.array([at.get(int(n["parent"]), -1) for n in nodes])
    xy = np.array([(n["x"], n["y"]) for n in nodes], float)
    up = np.array([(ROOT, ROOT) if p < 0 else xy[p] for p in parent])
    return parent, np.array([n["kw"] for n in nodes], float), np.maximum(np.hypot(*(xy - up).T), 1.0) / 1000


def load_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voltages, loading and losses of each feeder with the smallest cables that carry it; a flow that doesn't settle is a result."""

    def flow(batches):
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                parent, kw, km = _arrays(f.nodes)
                got = solve(parent, kw, km, smallest(parent, kw))
                if got["ok"]:
                    worst = int(np.argmax(got["loading"]))
                    rows.append((f.project, f.feeder, True, round(float(got["pu"].min()), 6), round(float(got["pu"].max()), 6), round(float(got["loading"].max()) * 100, 4), int(f.nodes[worst]["node"]), round(got["loss_kw"], 4)))
                else:
                    rows.append((f.project, f.feeder, False, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=["project", "feeder", "converged", "min_pu", "max_pu", "max_loading_pct", "worst_node", "loss_kw"]).astype({"worst_node": "Int32"})

    return _feeders(spark, sf_dir).mapInPandas(flow, "project int, feeder int, converged boolean, min_pu double, max_pu double, max_loading_pct double, worst_node int, loss_kw double")


def cable_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each feeder's repair: state, number of rounds, cables before and after, losses."""

    def mend(batches):
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                parent, kw, km = _arrays(f.nodes)
                cable, got, n, state = repair(parent, kw, km)
                name = lambda c: ",".join(f"C{i + 1}" for i in c)
                rows.append((f.project, f.feeder, state, n, name(smallest(parent, kw)), name(cable), round(got["loss_kw"], 4) if got["ok"] else None))
            yield pd.DataFrame(rows, columns=["project", "feeder", "state", "n_rounds", "cables_before", "cables_after", "loss_kw"])

    return _feeders(spark, sf_dir).mapInPandas(mend, "project int, feeder int, state string, n_rounds int, cables_before string, cables_after string, loss_kw double")


QUERIES = (load_flow, cable_repair)
