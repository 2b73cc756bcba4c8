"""Kernels that keep scores against plain recomputation, and on graphs of a size that quadratic forms do not finish in the time given."""

import time

import numpy as np
import pytest

from weftline.operators import attacks as A
from weftline.operators import local as L
from weftline.operators import search as S
from weftline.operators import solvers as V


def sparse(n, m, seed=0, most=1):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, n, 2 * m), rng.integers(0, n, 2 * m)
    key = rng.permutation(np.unique((np.minimum(a, b) * n + np.maximum(a, b))[a != b]))[:m]
    return np.arange(n), key // n, key % n, rng.integers(1, most + 1, len(key)).astype(float)


def within(seconds, kernel, graph):
    start = time.process_time()
    out = list(kernel(*graph))
    assert time.process_time() - start < seconds
    return out


def plain_order(near, score, batch):
    near, order = [set(x) for x in near], []
    while any(near):
        value = np.where([bool(x) for x in near], score(near), -np.inf)
        for x in np.argsort(-value, kind="stable")[:batch].tolist():
            if near[x]:
                for y in near[x]:
                    near[y].discard(x)
                near[x] = set()
                order.append(x)
    return order


def plain_reinsert(near, removed, strategy, step, cost):
    gone, back = set(removed), []

    def score(x):
        seen, sizes = set(), []
        for y in near[x] - gone:
            if y not in seen:
                part = {y}
                todo = [y]
                for z in todo:
                    new = near[z] - gone - part
                    part |= new
                    todo += new
                seen |= part
                sizes.append(len(part))
        value = {"count": len(sizes), "rank": 1 + sum(sizes), "multiple": (1 + sum(sizes)) * len(sizes)}[strategy]
        return value * (1 if cost is None else cost[x]), x

    while gone:
        for x in sorted(gone, key=score)[:step]:
            gone.discard(x)
            back.append(x)
    return back[::-1]


@pytest.mark.parametrize("kind", ["degree", "corehd", "collective_influence", "collective_influence_l2"])
def test_kept_scores(kind):
    for seed in range(6):
        ids, src, dst, _ = sparse(40, 30 + 15 * seed, seed)
        near = L.neighbours(40, src, dst)
        for batch in (1, 3):
            plain = plain_order(near, A.SCORES[kind], batch)
            assert A.attack_order(near, A.SCORES[kind], batch)[: len(plain)] == plain
    n, used, *_ = within(25, A.attack(kind), sparse(10_000, 24_000))[0]
    assert n == 10_000 and 4_000 < used < 8_000


@pytest.mark.parametrize("strategy", ["count", "rank", "multiple"])
def test_reinsertion(strategy):
    for seed in range(6):
        ids, src, dst, _ = sparse(40, 30 + 15 * seed, seed)
        near = L.neighbours(40, src, dst)
        removed = L.adaptive_degree_order(near)[:30]
        for step, cost in ((1, None), (1, A.degree_cost(near)), (3, None)):
            assert L.reinsert(near, removed, strategy, step, cost) == plain_reinsert(near, removed, strategy, step, cost)
    for kernel in (A.reinserted(strategy), A.reinserted(strategy, True), L.reinsertion):
        assert within(25, kernel, sparse(10_000, 24_000))


def test_greedy_cover():
    ids, src, dst, _ = sparse(40, 90)
    assert [x for _, x in L.greedy_cover(ids, src, dst, None)] == plain_order(L.neighbours(40, src, dst), A.degree_score, 1)
    assert within(15, L.greedy_cover, sparse(30_000, 71_000))


def weights(ids, src, dst, w):
    out = np.zeros((len(ids), len(ids)))
    np.add.at(out, (src, dst), w)
    return out + out.T


def test_sets_and_covers():
    for seed in range(6):
        g = sparse(40, 20 + 15 * seed, seed)
        near = L.neighbours(40, g[1], g[2])
        live, want = set(range(40)), []
        while live:
            x = max(live, key=lambda k: ((len(near[k]) + 1) / (1 + len(near[k] & live)), -k))
            live -= near[x] | {x}
            want.append(x)
        assert [x for _, x in V.weighted_set(*g)] == want
        live, want = set(range(40)), []
        while live:
            x = max(range(40), key=lambda k: (len((near[k] | {k}) & live), -k))
            live -= near[x] | {x}
            want.append(x)
        assert [x for _, x in V.dominating_set(*g)] == want
        held = {s: set(g[2][g[1] == s].tolist()) for s in set(g[1].tolist())}
        left, want = set(g[2].tolist()), []
        while left:
            s = max(held, key=lambda k: (len(held[k] & left), -k))
            want.append((len(want), s, len(held[s] & left)))
            left -= held[s]
        assert list(V.set_cover(*g)) == want
    for kernel in (V.weighted_set, V.dominating_set, V.set_cover):
        assert within(20, kernel, sparse(30_000, 71_000))
    assert within(40, V.annealed_set, sparse(40_000, 95_000))


def test_sparse_forms():
    """A dense form of 100,000 nodes would take 80 GB."""
    for seed in range(6):
        g = sparse(40, 20 + 15 * seed, seed, 3)
        a, b, x, flips = weights(*g), V.node_bias(g[0]), np.zeros(40), 0
        while (gain := (1 - 2 * x) * (b + a @ x)).min() < 0:
            k = int(np.argmin(gain))
            x[k], flips = 1 - x[k], flips + 1
        assert list(V.descended_form(*g)) == [(40, float(x @ b + x @ a @ x / 2), flips)]
        k, rng, best = a.sum(1), np.random.default_rng([0, 40]), 0.0
        two = k.sum()
        for _ in range(10):
            side = rng.choice([-1.0, 1.0], 40)
            while (gain := -side * (a @ side) * two + side * k * (k @ side) - k * k).max() > 0:
                side[int(np.argmax(gain))] *= -1
            best = max(best, V.modularity(a, side))
        assert next(iter(V.climbed_modularity(*g)))[1] == pytest.approx(best)
    large = sparse(100_000, 238_000, most=2)
    total = large[3].sum()
    assert total / 2 < within(60, lambda *g: V.annealed_cut(*g, sweeps=5), large)[0][1] <= total
    assert within(60, V.descended_form, large)[0][1] < 0
    assert within(60, lambda *g: V.climbed_modularity(*g, restarts=1), large)[0][1] > 0.2
    assert within(5, V.spectral_modularity, large) == [(100_000, None)]


def test_laplacian_without_dense_table():
    for seed in range(3):
        ids, src, dst, w = sparse(120, 150, seed)
        src, dst = np.concatenate([src, np.arange(119)]), np.concatenate([dst, np.arange(1, 120)])
        dense, loose = ([x for _, x in V.laplacian_coordinates(ids, src, dst, None, dense=d)] for d in (1500, 0))
        assert np.allclose(dense, loose, atol=1e-6)
    # a path of 3, one of 2, a node alone, a ring of 30: two of three components, then eigenvectors of the ring
    src, dst = np.array([0, 1, 3, *range(6, 36)]), np.array([1, 2, 4, *range(7, 36), 6])
    rows = np.array([x for _, x in V.laplacian_coordinates(np.arange(36), src, dst, None, dense=0)])
    assert np.allclose(rows[[3, 4], 0], 0.5**0.5) and np.allclose(rows[6:, 1], 30**-0.5) and not rows[5].any()
    assert np.allclose((rows**2).sum(0), 1) and np.allclose((rows[6:, 2:] ** 2).sum(1), 2 / 30)
    ids, src, dst, w = sparse(40_000, 95_000)
    rows = np.array([x for _, x in within(90, V.laplacian_coordinates, (ids, np.concatenate([src, ids[:-1]]), np.concatenate([dst, ids[1:]]), None))])
    assert rows.shape == (40_000, 4) and np.allclose((rows**2).sum(0), 1)


def test_closeness_attack_and_search():
    for seed in range(6):
        ids, src, dst, _ = sparse(40, 20 + 12 * seed, seed)
        near = L.neighbours(40, src, dst)
        plain = plain_order(near, A.closeness_score, 1)
        assert A.attack_order(near, A.closeness_score)[: len(plain)] == plain
        want = [sum(d := A.distances(near, x).values()) and (len(d) - 1) ** 2 / (sum(d) * 39) for x in range(40)]
        assert [c for _, c in S.closeness(ids, src, dst, None)] == want
    assert within(25, A.attack("closeness"), sparse(1_000, 2_400))
    assert len(within(25, S.closeness, sparse(10_000, 24_000))) == 10_000


def test_betweenness_attack():
    """Scores of the removed node's piece alone computed anew, on one and on several pieces, equal to plain ones; scores that only rounding parts go by node."""

    def rounded(near):
        return np.array([float(f"{x:.9e}") for x in A.betweenness_score(near)])

    for seed in range(6):
        near = L.neighbours(40, *sparse(40, (25, 45, 90)[seed % 3], seed)[1:3])
        order = plain_order(near, rounded, 1)
        assert A.attack_order(near, A.betweenness_score)[: len(order)] == order
    piece = sparse(150, 350)
    src, dst = (np.concatenate([x + 150 * k for k in range(4)]) for x in piece[1:3])
    assert within(30, A.attack("betweenness"), (np.arange(600), src, dst, np.ones(len(src))))


def test_closeness_of_many_pieces(monkeypatch):
    """Searches of different pieces share their bits: 400 pieces of 150 nodes and a node alone take three passes, not 938."""
    from weftline.operators import bfs

    _, src, dst, _ = sparse(150, 350)
    one = bfs.all_distance_sums(*bfs.sorted_links(150, src, dst))
    src, dst = (np.concatenate([x + 150 * k for k in range(400)]) for x in (src, dst))
    passes, levels = [], bfs.levels
    monkeypatch.setattr(bfs, "levels", lambda *a: passes.append(1) or levels(*a))
    got = bfs.all_distance_sums(*bfs.sorted_links(60_001, src, dst))
    assert len(passes) <= 3
    for a, b in zip(one, got):
        assert (b[:-1] == np.tile(a, 400)).all() and b[-1] == 0


def test_betweenness_of_many_pieces(monkeypatch):
    """Searches have tables of their piece, not of the whole graph, and the same sums."""
    from weftline.operators import bfs

    _, src, dst, _ = sparse(150, 200)
    src, dst = (np.concatenate([x + 150 * k for k in range(20)]) for x in (src, dst))
    links, own = bfs.sorted_links(3001, src, dst), np.arange(0, 3001, 3)
    want = bfs.dependencies(*links, own)
    longest, passed = [], bfs._passed
    monkeypatch.setattr(bfs, "_passed", lambda start, *a: longest.append(len(start)) or passed(start, *a))
    assert np.allclose(bfs.by_piece(*links, own, group=100), want) and max(longest) < 300
    assert len(bfs.by_piece(np.zeros(1, int), np.zeros(0, int), np.zeros(0, int))) == 0
