"""Processes on graphs: mean-field epidemics, coupled maps, population dynamics, cascades, spreading, layered connectivity.

Kernels of one graph, for ``local.per_graph``; a process takes tens of rounds, and a round as joins
would be a shuffle each. ``combat_chains`` and ``steady_state`` are plain aggregations.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.local import Union

#: Defaults of the processes.
SIS = {"beta": 0.3, "rounds": 20, "start": 0.5}
GLV = {"dt": 0.05, "decay": 1.0, "coupling": 0.5, "growth": 1.0, "clamp": 10.0}
CASCADE = {"alpha": 1.0, "power": 1.0, "tolerance": 0.2, "rounds": 20}


def _near_sum(n, src, dst, x):
    """Sum of ``x`` over the neighbours of every node."""
    return np.bincount(src, x[dst], minlength=n) + np.bincount(dst, x[src], minlength=n)


def sis_risk(ids, src, dst, weight, beta=SIS["beta"], rounds=SIS["rounds"], start=SIS["start"]):
    """Expected infected nodes of the mean-field susceptible-infected-susceptible process."""
    p = np.full(len(ids), start)
    for _ in range(rounds):
        f = beta * _near_sum(len(ids), src, dst, p)
        p = f / (1 + f)
    yield len(ids), float(p.sum())


def coupled_map(ids, src, dst, weight, theta=1.5, push=0.2, steps=20):
    """Trajectory of x <- tanh(theta * mean of neighbours + push), from zero: step, node, value."""
    n = len(ids)
    degree = np.maximum(_near_sum(n, src, dst, np.ones(n)), 1)
    x = np.zeros(n)
    for t in range(steps):
        x = np.tanh(theta * _near_sum(n, src, dst, x) / degree + push)
        yield from ((t, int(i), float(v)) for i, v in zip(ids, x, strict=True))


def glv(ids, src, dst, weight, steps=20, start=None, mean=True, dt=GLV["dt"], decay=GLV["decay"], coupling=GLV["coupling"], growth=GLV["growth"], clamp=GLV["clamp"]):
    """Euler steps of generalised Lotka-Volterra dynamics, by neighbour mean or sum: step, node, value."""
    n = len(ids)
    degree = np.maximum(_near_sum(n, src, dst, np.ones(n)), 1) if mean else 1
    x = (np.asarray(ids) % 5 + 1) / 10 if start is None else start(ids)
    for t in range(steps):
        rate = growth - decay * x + coupling * _near_sum(n, src, dst, x) / degree
        x = np.clip(x + dt * x * rate, 0, clamp)
        if not np.isfinite(x).all():
            raise FloatingPointError("the population diverged: lower dt or coupling")
        yield from ((t, int(i), float(v)) for i, v in zip(ids, x, strict=True))


def steady_state(series: DataFrame, key: list[str], step: str, value: str, window: int = 10, noise: float = 0.0, tolerance: float = 0.05) -> DataFrame:
    """Per series: ``steady``, the lower median of its last ``window`` steps, and ``settled``, whether their halves agree."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(step).desc()))
    of = series.withColumn("_back", last).where(F.col("_back") <= window)
    late = F.col("_back") <= window - max(1, window // 2)
    of = of.groupBy(*key).agg(F.sort_array(F.collect_list(value)).alias("v"), F.abs(F.avg(F.when(late, F.col(value))) - F.avg(F.when(~late, F.col(value)))).alias("drift"))
    steady = F.element_at("v", ((F.size("v") - 1) / 2).cast("int") + 1)
    return of.select(*key, steady.alias("steady"), F.col("drift")).withColumn("settled", (F.col("drift") < 3 * noise + 1e-3) | (F.col("drift") / (F.abs("steady") + 1e-6) < tolerance))


def combat_chains(edges: DataFrame, role: str = "role") -> DataFrame:
    """graph_id, chains: sensor-decision-influence paths, from (graph_id, decision, other, role 'S' or 'I')."""
    arms = edges.groupBy("graph_id", "decision").agg(F.count(F.when(F.col(role) == "S", 1)).alias("s"), F.count(F.when(F.col(role) == "I", 1)).alias("i"))
    return arms.groupBy("graph_id").agg(F.sum(F.col("s") * F.col("i")).alias("chains"))


def mutual_groups(n: int, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Group of every node so that a group is connected in each layer inside itself; refined until stable."""
    group = np.zeros(n, int)
    while True:
        before = group
        for src, dst in layers:
            u = Union(n)
            inside = group[src] == group[dst]
            for a, b in zip(src[inside].tolist(), dst[inside].tolist(), strict=True):
                u.join(a, b)
            label = np.fromiter((u.root(k) for k in range(n)), int, n)
            group = np.unique(group * n + label, return_inverse=True)[1]
        if group.max(initial=0) == before.max(initial=0):
            return group


def mutual_component(ids, src, dst, weight):
    """Size of the largest mutually connected component; ``weight`` is the layer of an edge."""
    layers = [(src[weight == k], dst[weight == k]) for k in np.unique(weight)]
    group = mutual_groups(len(ids), layers) if layers else np.arange(len(ids))
    yield len(ids), int(np.bincount(group).max(initial=0))


def cascade(ids, src, dst, weight, removed=lambda ids: ids % 7 == 0, alpha=CASCADE["alpha"], power=CASCADE["power"], tolerance=CASCADE["tolerance"], rounds=CASCADE["rounds"]):
    """Nodes that survive when the load of removed ones moves through hyperedges to members with room.

    An incidence table as a graph: ``src`` are nodes, ``dst`` is unused, ``weight`` the hyperedge. A node's load is
    alpha * degree ** power, its capacity (1 + tolerance) times that. A failed node's load goes to its hyperedges by
    their free room, and from each to its live members by theirs; overloaded members fail in the next round.
    """
    n, edge = len(ids), np.unique(weight, return_inverse=True)[1] if len(weight) else np.zeros(0, int)
    m = int(edge.max(initial=-1)) + 1
    load = alpha * np.bincount(src, minlength=n).astype(float) ** power
    room_limit = load * (1 + tolerance)
    failing = np.asarray(removed(np.asarray(ids)), bool)
    live = ~failing
    for _ in range(rounds):
        if not failing.any():
            break
        room = np.where(live, np.maximum(room_limit - load, 0), 0)
        of_edge = np.bincount(edge, room[src], minlength=m)
        give = np.where(failing[src], of_edge[edge], 0)
        whole = np.bincount(src, give, minlength=n)
        sent = np.bincount(edge, np.divide(load[src] * give, whole[src], out=np.zeros(len(src)), where=whole[src] > 1e-9), minlength=m)
        got = np.divide(sent[edge] * room[src], of_edge[edge], out=np.zeros(len(src)), where=of_edge[edge] > 1e-9)
        load = np.where(live, load + np.bincount(src, got, minlength=n), 0)
        failing = live & (load > room_limit + 1e-9)
        live &= ~failing
    yield from ((int(i), bool(x)) for i, x in zip(ids, live, strict=True))


def influence(ids, src, dst, weight, budget=0.1, p=0.1, runs=16, rounds=None, retry=True, seed=0):
    """Mean nodes reached from the ``budget`` share of highest degree, over ``runs`` seeded simulations.

    With ``retry`` every active node tries its neighbours in every round, else only in the round after it became active.
    """
    n = len(ids)
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    degree = np.bincount(a, minlength=n)
    seeds = np.argsort(-degree, kind="stable")[: int(np.ceil(budget * n))]
    rng = np.random.default_rng([seed, n, len(a)])
    on = np.zeros((runs, n), bool)
    on[:, seeds] = True
    fresh = on.copy()
    for _ in range(rounds or n):
        if not len(a):
            break
        tries = (on if retry else fresh)[:, a] & (rng.random((runs, len(a))) < p)
        new = np.zeros((runs, n), bool)
        at = np.nonzero(tries)
        new[at[0], b[at[1]]] = True
        fresh = new & ~on
        if not fresh.any():
            break
        on |= new
    yield n, len(seeds), float(on.sum(1).mean())
