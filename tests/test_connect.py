"""Connectivity in joins against union-find, prefix by prefix, on random graphs, chains, stars and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import connect as C
from weftline.operators import local as L


def random_graphs(rng):
    """Graph name: n and edges; sparse, dense, a chain, a star, isolated nodes, no edges, one node."""
    out = {f"r{k}": (30, {tuple(sorted(rng.choice(30, 2, replace=False).tolist())) for _ in range(m)}) for k, m in enumerate((8, 25, 60))}
    out["chain"] = (40, {(k, k + 1) for k in range(39)})
    out["star"] = (20, {(0, k) for k in range(1, 20)})
    out |= {"none": (4, set()), "one": (1, set())}
    return out


@pytest.fixture(scope="module")
def graphs():
    return random_graphs(np.random.default_rng(5))


@pytest.fixture(scope="module")
def tables(spark, graphs):
    nodes = spark.createDataFrame([(g, k) for g, (n, _) in graphs.items() for k in range(n)], "graph_id string, node_id long")
    rows = [(g, a, b, 1) for g, (_, e) in graphs.items() for a, b in e]
    odd = [("r0", 3, 3, 1), ("r0", None, 2, 1), ("r0", 2, 99, 1), ("r1", *list(graphs["r1"][1])[0][::-1], 1), ("r1", *list(graphs["r1"][1])[0], 1), (None, 1, 2, 1)]
    return nodes, spark.createDataFrame(rows + odd, "graph_id string, src long, dst long, weight long").repartition(3)


def groups(n, edges, alive=None):
    alive = set(range(n)) if alive is None else alive
    u = L.Union(n)
    for a, b in edges:
        if a in alive and b in alive:
            u.join(a, b)
    of = {}
    for x in sorted(alive):
        of.setdefault(u.root(x), []).append(x)
    return list(of.values())


@pytest.mark.parametrize("in_task", [0, 20, 50_000])
def test_components(tables, graphs, in_task):
    """All graphs in joins, the larger ones, none."""
    got = {(r.graph_id, r.node_id): r.label for r in C.components(*tables, in_task=in_task).collect()}
    want = {(g, x): max(own) for g, (n, e) in graphs.items() for own in groups(n, e) for x in own}
    assert got == want
    nodes, edges = tables
    assert C.components(nodes.limit(0), edges).count() == 0
    assert C.components(nodes, edges.limit(0)).where("label != node_id").count() == 0


def plain_curve(n, edges, step):
    out = {}
    for k in {0} | {s + 1 for s in step.values()}:
        own = groups(n, edges, {x for x in range(n) if step.get(x, 1 << 40) >= k})
        out[k] = (max(map(len, own), default=0), sum(len(x) * (len(x) - 1) // 2 for x in own))
    return out


@pytest.mark.parametrize("kind", ["all", "gaps"])
def test_removal_curve(spark, tables, graphs, kind, monkeypatch):
    monkeypatch.setattr(C, "STRIPE", 2)
    rng = np.random.default_rng(len(kind))
    steps = {}
    for g, (n, _) in graphs.items():
        order = list(range(n)) if g == "chain" and kind == "all" else rng.permutation(n).tolist()
        place = {x: k for k, x in enumerate(order)}
        steps[g] = {"all": place, "some": {x: k for x, k in place.items() if k < n // 2}, "together": {x: k // 3 for x, k in place.items()}, "gaps": {x: 5 * k for x, k in place.items() if k % 2}}[kind]
    order = spark.createDataFrame([(g, x, s) for g, own in steps.items() for x, s in own.items()], "graph_id string, node_id long, step long")
    got = {}
    for r in C.removal_curve(*tables, order).collect():
        got.setdefault(r.graph_id, {})[r.removed] = (r.largest, r.pairs)
    assert got == {g: plain_curve(n, e, steps[g]) for g, (n, e) in graphs.items()}


def test_removal_curve_in_joins_and_tasks(spark, tables, graphs):
    """Graphs in tasks and larger ones in joins have the same curves, with ties, nodes without a step and graphs without any."""
    rng = np.random.default_rng(8)
    steps = [(g, x, int(rng.integers(0, n))) for g, (n, _) in graphs.items() for x in range(n) if g != "r2" and rng.random() < 0.8]
    order = spark.createDataFrame(steps, "graph_id string, node_id long, step long")
    tasks, mixed = ({tuple(r) for r in C.removal_curve(*tables, order, in_task=k).collect()} for k in (1000, 30))
    assert tasks == mixed and len(mixed) > 50


def test_robustness_of_star_and_path(spark):
    nodes = spark.createDataFrame([(g, k) for g in "sp" for k in range(4)], "graph_id string, node_id long")
    edges = spark.createDataFrame([("s", 0, k) for k in (1, 2, 3)] + [("p", k, k + 1) for k in range(3)], "graph_id string, src long, dst long")
    order = spark.createDataFrame([("s", k, k) for k in range(4)] + [("p", x, k) for k, x in enumerate((1, 0, 2, 3))], "graph_id string, node_id long, step long")
    got = {r.graph_id: (r.nd, r.cn) for r in C.robustness(nodes, edges, order).collect()}
    assert got == {"s": (3 / 16, 0), "p": (5 / 16, pytest.approx(1 / 12))}
    priced = nodes.withColumn("cost", F.col("node_id") + 1)
    got = {r.graph_id: (r.nd_cost, r.cn_cost) for r in C.cost_robustness(priced, edges, order, "cost").collect()}
    assert got["p"] == (pytest.approx(0.225), pytest.approx(0.05)) and got["s"][1] == 0


def plain_mutual(n, layers):
    sets = [set(range(n))]
    while True:
        new = []
        for own in sets:
            parts = [own]
            for e in layers:  # an empty layer parts all
                parts = [set(x) & p for p in parts for x in groups(n, [y for y in e if y[0] in own and y[1] in own], own) if set(x) & p]
            new += parts
        if len(new) == len(sets):
            return {x: max(s) for s in sets for x in s}
        sets = new


def test_mutual_components(spark):
    """Layers whose components cross, so that several rounds split them; a layer that one graph lacks."""
    rng = np.random.default_rng(2)
    chain = lambda order: [tuple(sorted(p)) for p in zip(order, order[1:])]
    cases = {"cross": (12, [chain(range(12)), chain([0, 1, 2, 6, 7, 3, 4, 5]) + [(8, 9), (10, 11)]]), "two": (3, [[(0, 1), (1, 2)], [(0, 1)]]), "lack": (3, [[(0, 1)], []])}
    cases |= {f"r{k}": (16, [[tuple(sorted(rng.choice(16, 2, replace=False).tolist())) for _ in range(22)] for _ in range(2)]) for k in range(3)}
    nodes = spark.createDataFrame([(g, k) for g, (n, _) in cases.items() for k in range(n)], "graph_id string, node_id long")
    layers = spark.createDataFrame([(g, f"l{j}", a, b) for g, (_, own) in cases.items() for j, e in enumerate(own) for a, b in e], "graph_id string, layer string, src long, dst long")
    got = {}
    for r in C.mutual_components(nodes, layers).collect():
        got.setdefault(r.graph_id, {})[r.node_id] = r.label
    assert got == {g: plain_mutual(n, own) for g, (n, own) in cases.items()}
    assert C.mutual_components(nodes, layers.limit(0)).groupBy("graph_id").agg(F.count_distinct("label").alias("k")).where("k > 1").count() == 0
