"""Per-graph heuristics on hand-sized graphs, and on random ones by what must hold."""

import numpy as np
import pytest

from weftline.operators import local as L
from weftline.operators import search as S

TRIANGLE_TAIL = (np.arange(5), np.array([0, 1, 0, 2, 3]), np.array([1, 2, 2, 3, 4]), np.ones(5))


def random_graph(seed, n=14, p=0.4):
    rng = np.random.default_rng(seed)
    src, dst = np.triu_indices(n, 1)
    on = rng.random(len(src)) < p
    return np.arange(n), src[on], dst[on], rng.choice([-1.0, 1.0, 2.0], on.sum())


def test_two_core():
    assert [x for (x,) in S.two_core(*TRIANGLE_TAIL)] == [0, 1, 2]


def test_of_no_edges():
    none = np.zeros(0, int)
    bare = (np.arange(3), none, none, np.zeros(0))
    assert list(S.two_core(*bare)) == [] and [x for _, x in S.independent_set(*bare)] == [0, 1, 2]
    assert {c for _, c in S.colouring(*bare)} == {0} and list(S.local_cut(*bare)) == [(3, 0.0, 0)]
    assert [round(r, 9) for _, r in S.pagerank(*bare)] == [round(1 / 3, 9)] * 3 and {c for _, c in S.closeness(*bare)} == {0.0}


@pytest.mark.parametrize("seed", range(4))
def test_invariants(seed):
    g = random_graph(seed)
    near = L.neighbours(len(g[0]), g[1], g[2])
    chosen = [x for _, x in S.independent_set(*g)]
    assert not any(y in near[x] for x in chosen for y in chosen)
    assert all(x in chosen or near[x] & set(chosen) for x in range(len(near)))
    colour = dict(S.colouring(*g))
    assert all(colour[x] != colour[y] for x in range(len(near)) for y in near[x])
    assert max(colour.values()) <= max(len(x) for x in near)
    cut = next(iter(S.local_cut(*g)))[1]
    best = next(iter(L.best_cut(*g)))[1]
    assert 0 <= cut <= best and best <= max(2 * cut, cut + np.abs(g[3]).sum())
    assert abs(sum(r for _, r in S.pagerank(*g)) - 1) < 1e-9


def test_closeness_of_path():
    path = (np.arange(3), np.array([0, 1]), np.array([1, 2]), np.ones(2))
    assert [round(c, 6) for _, c in S.closeness(*path)] == [round(2 / 3, 6), 1.0, round(2 / 3, 6)]
