"""Attacks and processes against plain recomputation on small graphs."""

import numpy as np
import pytest

from weftline.operators import attacks as A
from weftline.operators import dynamics as D
from weftline.operators import local as L


def graph(seed, n=12, p=0.3):
    rng = np.random.default_rng(seed)
    src, dst = np.triu_indices(n, 1)
    on = rng.random(len(src)) < p
    return np.arange(n), src[on], dst[on], np.ones(on.sum())


def parts(near, gone):
    left, sizes = set(range(len(near))) - gone, []
    while left:
        found = {left.pop()}
        todo = list(found)
        for x in todo:
            new = (near[x] - gone) & left
            left -= new
            found |= new
            todo += new
        sizes.append(len(found))
    return sizes


@pytest.mark.parametrize("kind", A.SCORES)
def test_attack_against_recount(kind):
    ids, src, dst, w = graph(3)
    near, n = L.neighbours(12, src, dst), 12
    order = A.attack_order(near, A.SCORES[kind])
    assert sorted(order) == list(range(12))
    cost = A.degree_cost(near)
    nd = sum(max(parts(near, set(order[:k])), default=0) for k in range(1, n)) / n**2
    cn = sum(sum(c * (c - 1) / 2 for c in parts(near, set(order[:k]))) * cost[order[k - 1]] for k in range(1, n)) / cost.sum() / (n * (n - 1) / 2)
    row = next(iter(A.attack(kind)(ids, src, dst, w)))
    assert row[2] == pytest.approx(nd) and row[5] == pytest.approx(cn)
    assert all(len(near[x] - set(order[: row[1]])) == 0 for x in order[row[1] :])


def test_betweenness_agrees():
    ids, src, dst, w = graph(5)
    one = [s for _, s in L.betweenness(ids, src, dst, w)]
    assert np.allclose(A.betweenness_score(L.neighbours(12, src, dst)) * 11 * 10 / 2, one)


def test_empty_graphs():
    bare = (np.arange(3), np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    none = (np.zeros(0, int),) * 3 + (np.zeros(0),)
    for g in (bare, none):
        for kind in A.SCORES:
            assert next(iter(A.attack(kind)(*g)))[1] == 0
        for kernel in (D.sis_risk, D.influence, D.mutual_component, A.searched(rounds=3), A.reinserted("rank"), A.edge_attack()):
            assert len(list(kernel(*g))) == 1


@pytest.mark.parametrize("learn", [False, True])
def test_search_never_worse(learn):
    for seed in range(3):
        _, plain, found = next(iter(A.searched(learn, 60)(*graph(seed))))
        assert found <= plain + 1e-12


def test_mutual_component():
    # a path 0-1-2-3 in one layer; 0-1 and 2-3 in the other
    src, dst, layer = np.array([0, 1, 2, 0, 2]), np.array([1, 2, 3, 1, 3]), np.array([0, 0, 0, 1, 1.0])
    assert list(D.mutual_component(np.arange(4), src, dst, layer)) == [(4, 2)]
    assert list(D.mutual_component(np.arange(4), src[:3], dst[:3], layer[:3])) == [(4, 4)]


def test_cascade_by_hand():
    """Node 0 fails; its load 1 goes to nodes 1 and 2 of the one hyperedge, 0.5 each: over 1.2 both fail, over 1.6 none does."""
    src, edge = np.array([0, 1, 2]), np.zeros(3)
    run = lambda t: [x for _, x in D.cascade(np.arange(3), src, src, edge, removed=lambda ids: ids == 0, tolerance=t)]
    assert run(0.2) == [False, False, False] and run(0.6) == [False, True, True]


def test_influence_bounds():
    g = graph(1)
    _, seeds, reached = next(iter(D.influence(*g, p=1.0, runs=2)))
    near = L.neighbours(12, g[1], g[2])
    first = [k for k in np.argsort([-len(x) for x in near], kind="stable")[:seeds]]
    whole = set(first)
    for x in (todo := list(first)):
        todo += near[x] - whole
        whole |= near[x]
    assert reached == len(whole) and next(iter(D.influence(*g, p=0.0)))[2] == seeds


def test_steady_state(spark):
    rows = [(0, t, 5.0) for t in range(12)] + [(1, t, float(t)) for t in range(12)] + [(2, 0, 1.0)]
    got = {r.k: r for r in D.steady_state(spark.createDataFrame(rows, "k long, t long, v double"), ["k"], "t", "v").collect()}
    assert got[0].steady == 5.0 and got[0].settled and got[1].steady == 6.0 and not got[1].settled and got[1].drift == 5.0
    assert got[2].steady == 1.0 and got[2].settled is None


def test_registered_closeness_is_computed_after_each_removal(spark, monkeypatch):
    """Also on graphs of more than 200 nodes."""
    from weftline.plans import attack_queries as Q

    edges = [(k, (k * 7 + 3) % 260) for k in range(260)] + [(k, k // 2) for k in range(1, 260)]
    edges = sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})
    nodes = spark.createDataFrame([("g", k) for k in range(260)], "graph_id string, node_id long")
    links = spark.createDataFrame([("g", a, b, 1) for a, b in edges], "graph_id string, src long, dst long, weight long")
    monkeypatch.setattr(Q, "_brand", lambda *_: (nodes, links))
    near = [set() for _ in range(260)]
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    every, second = (A.robustness(near, A.attack_order(near, A.SCORES["closeness"], k)) for k in (1, 2))
    got = Q.QUERIES["attack_closeness"](spark, "").first()
    assert every != second and abs(got.nd - every[0]) < 1e-9 and abs(got.cn - every[1]) < 1e-9


def test_curve_of_changed_places():
    """Totals of moved orders, taken or not, against the whole curve."""
    rng = np.random.default_rng(2)
    for n, m in ((5, 4), (40, 60), (90, 70)):
        near = L.neighbours(n, rng.integers(0, n, m), rng.integers(0, n, m))
        order = rng.permutation(n)
        curve = A.Curve(near, order, kept=4)
        for t in range(60):
            trial, i, j = A._moved(order, A.MOVES[t % 3], n, rng)
            assert curve.trial(trial, i, j) == sum(c[0] for c in L.dismantling_curve(trial.tolist(), near)[1:n])
            if rng.random() < 0.5:
                curve.take(trial, i, j)
                order = trial


def test_pagerank_attack_keeps_its_links():
    """The same removals as by scores of links made anew."""
    rng = np.random.default_rng(4)
    for n, m in ((6, 5), (50, 90)):
        near = L.neighbours(n, rng.integers(0, n, m), rng.integers(0, n, m))
        assert A.attack_order(near, A.pagerank_score) == A.attack_order(near, lambda now: A.pagerank_score(now))
        assert A._pagerank_removals([set(x) for x in near]) == A.attack_order(near, A.pagerank_score)[: A.removals(near, A.attack_order(near, A.pagerank_score))]


@pytest.mark.parametrize("kind", A.LOCAL)
def test_attack_in_parts(spark, monkeypatch, kind):
    """Pieces attacked apart and merged give what the whole graph gives; equal pieces, too."""
    rng = np.random.default_rng(8)
    rows, nodes, want = [], [], {}
    for g, m in (("a", 40), ("b", 95)):
        src, dst = rng.integers(0, 50, m), rng.integers(0, 50, m)
        src, dst = np.concatenate([src, src + 50, [100]]), np.concatenate([dst, dst + 50, [101]])
        kept = sorted({(min(e), max(e)) for e in zip(src.tolist(), dst.tolist()) if e[0] != e[1]})
        src, dst = map(np.array, zip(*kept))
        nodes += [(g, k) for k in range(103)]
        rows += [(g, a, b, 1) for a, b in kept]
        want[g] = next(iter(A.attack(kind)(np.arange(103), src, dst, np.ones(len(src)))))
    bare = ("c", 5), ("c", 7)
    frames = spark.createDataFrame([*nodes, *bare], "graph_id string, node_id long"), spark.createDataFrame(rows, "graph_id string, src long, dst long, weight long")
    whole = A.pieces
    monkeypatch.setattr(A, "pieces", lambda n, src, dst: whole(n, src, dst, 1))
    got = {r.graph_id: tuple(r)[1:] for r in A.attack_in_parts(*frames, kind).collect()}
    want["c"] = next(iter(A.attack(kind)(np.arange(2), *[np.zeros(0, int)] * 2, np.zeros(0))))
    assert got == {g: pytest.approx(x) for g, x in want.items()}


def test_closeness_and_influence_of_many_pieces_in_time(spark):
    """The parts of a graph of many pieces are many, so that tasks share them."""
    src = np.concatenate([np.arange(9) + 10 * k for k in range(3000)])
    assert len(np.unique(A.pieces(30_000, src, src + 1, 1000))) > 200
