"""Solvers against enumeration on small graphs."""

import itertools

import numpy as np
import pytest

from weftline.operators import local as L
from weftline.operators import solvers as V
from tests.test_attacks import graph


def subsets(n):
    return itertools.product((0, 1), repeat=n)


@pytest.mark.parametrize("seed", range(3))
def test_sets(seed):
    g = graph(seed, 9, 0.35)
    near = L.neighbours(9, g[1], g[2])
    free = [s for s in subsets(9) if not any(s[a] and s[b] for a, b in zip(g[1], g[2], strict=True))]
    n, size, cover, heavy = next(iter(V.exact_sets(*g)))
    assert size == max(map(sum, free)) and cover == 9 - size
    assert heavy == max(sum((len(near[k]) + 1) * s[k] for k in range(9)) for s in free)
    found = [x for _, x in V.weighted_set(*g)]
    assert tuple(int(k in found) for k in range(9)) in free and next(iter(V.annealed_set(*g)))[1] <= size
    assert next(iter(V.annealed_set(*g, sweeps=200)))[1] >= size - 1
    ring = {x for _, x in V.dominating_set(*g)}
    assert all(k in ring or near[k] & ring for k in range(9))
    found = [x for _, x in V.clique(*g)]
    assert all(b in near[a] for a, b in itertools.combinations(found, 2))
    taken = {x for x, _ in V.edge_cover_nodes(*g)}
    assert all(a in taken or b in taken for a, b in zip(g[1], g[2], strict=True)) and len(taken) <= 2 * cover


@pytest.mark.parametrize("seed", range(3))
def test_forms_and_cuts(seed):
    ids, src, dst, _ = graph(seed, 9, 0.4)
    w = np.random.default_rng(seed).normal(size=len(src))
    b = V.node_bias(ids)
    value = lambda s: sum(b[k] * s[k] for k in range(9)) + sum(c * s[x] * s[y] for x, y, c in zip(src, dst, w, strict=True))
    least = next(iter(V.least_form(ids, src, dst, w)))[1]
    assert least == pytest.approx(min(map(value, subsets(9)))) and next(iter(V.descended_form(ids, src, dst, w)))[1] >= least - 1e-9
    best = next(iter(L.best_cut(ids, src, dst, w)))[1]
    cut = next(iter(V.annealed_cut(ids, src, dst, w)))[1]
    assert cut <= best + 1e-9 and cut >= 0.8 * best


def test_modularity_of_two_cliques():
    pairs = [(a, b) for a, b in itertools.combinations(range(8), 2) if (a < 4) == (b < 4)] + [(0, 4)]
    src, dst = map(np.array, zip(*pairs, strict=True))
    w, side = np.ones(len(src)), np.where(np.arange(8) < 4, 1.0, -1.0)
    q = V.modularity(V.matrix(8, src, dst, w), side)
    for kernel in (V.climbed_modularity, V.spectral_modularity):
        assert next(iter(kernel(np.arange(8), src, dst, w)))[1] == pytest.approx(q)
    assert all(len(x) == 4 for _, x in V.laplacian_coordinates(np.arange(8), src, dst, w))


def test_set_cover():
    src, dst = np.array([0, 0, 0, 1, 1, 2]), np.array([3, 4, 5, 5, 6, 6])
    assert list(V.set_cover(np.arange(7), src, dst, np.ones(6))) == [(0, 0, 3), (1, 1, 1)]


def test_nothing():
    none = (np.zeros(0, int),) * 3 + (np.zeros(0),)
    for k in (V.annealed_cut, V.annealed_set, V.least_form, V.descended_form, V.climbed_modularity, V.spectral_modularity, V.exact_sets):
        assert len(list(k(*none))) == 1
    for k in (V.weighted_set, V.dominating_set, V.clique, V.edge_cover_nodes, V.set_cover, V.laplacian_coordinates):
        assert list(k(*none)) == []


def test_registered_spectral_modularity_beyond_600_nodes(spark, monkeypatch):
    """A graph of 640 nodes has a value, that of the dense matrix's leading eigenvector; so have small ones."""
    from weftline.plans import attack_queries as Q

    rng = np.random.default_rng(5)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 640, (1600, 2)).tolist() if a != b})
    for n in (200, 640):
        some = [(a, b) for a, b in pairs if b < n]
        src, dst = map(np.array, zip(*some, strict=True))
        a = V.matrix(n, src, dst, np.ones(len(src)))
        k = a.sum(1)
        lead = np.linalg.eigh(a - np.outer(k, k) / k.sum())[1][:, -1]
        want = V.modularity(a, np.where(lead >= 0, 1.0, -1.0))
        assert next(iter(V.spectral_modularity(np.arange(n), src, dst, np.ones(len(src)), most=None)))[1] == pytest.approx(want)
    path = np.array([0, 1]), np.array([1, 2]), np.ones(2)
    assert next(iter(V.spectral_modularity(np.arange(3), *path, most=None)))[1] == 0
    nodes = spark.createDataFrame([("g", x) for x in range(640)], "graph_id string, node_id long")
    links = spark.createDataFrame([("g", x, y, 1) for x, y in some], "graph_id string, src long, dst long, weight long")
    monkeypatch.setattr(Q, "_brand", lambda *_: (nodes, links))
    assert Q.QUERIES["spectral_modularity"](spark, "").first().q == pytest.approx(want)


def test_set_covers_hold_little(spark, monkeypatch):
    """Sorted batches give what the kernel gives of whole tables, also where a batch ends within a set and an element has a set's number; the registered query makes no frame of a graph."""
    from weftline.plans import attack_queries as Q

    rng = np.random.default_rng(3)
    rows = sorted({(int(g), int(s), int(d)) for g, s, d in zip(rng.integers(0, 3, 900), rng.integers(0, 40, 900), rng.integers(0, 90, 900))})
    want = []
    for g in range(3):
        src, dst = (np.array([r[k] for r in rows if r[0] == g]) for k in (1, 2))
        want += [(g, *x) for x in V.set_cover(np.arange(130), src, dst + 40, None)]
    monkeypatch.setattr(Q, "_supplied", lambda *_: spark.createDataFrame(rows + rows[::7], "graph_id int, src long, dst long").selectExpr("nullif(graph_id, 2) graph_id", "src", "dst"))
    monkeypatch.setattr(Q.L, "per_graph", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert sorted((2 if g is None else g, *x) for g, *x in Q.set_cover(spark, "").collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
