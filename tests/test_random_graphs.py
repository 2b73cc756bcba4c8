"""Random graphs: exact degrees and counts, rates, independence of partitions, and size without pair tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import connect
from weftline.sources import generators as N


def sized(spark, *n):
    return spark.createDataFrame(list(enumerate(n)), "graph_id long, n long")


def pairs(frame):
    return sorted((r.graph_id, r.src, r.dst) for r in frame.collect())


@pytest.mark.parametrize("n", [2, 3, 7, 100, 3_000_000_000])
def test_corner(n):
    total = n * (n - 1) // 2
    k = np.unique(np.clip(np.r_[np.arange(40), np.linspace(0, total - 1, 50).astype(np.int64), total - 1 - np.arange(40)], 0, total - 1)).astype(np.int64)
    i, j = N._corner(k, n)
    assert ((0 <= i) & (i < j) & (j < n)).all() and (i * (2 * n - i - 1) // 2 + j - i - 1 == k).all()


def test_erdos_renyi(spark):
    of = sized(spark, 0, 1, 2, 500, 500)
    got = pairs(N.erdos_renyi(of, 0.1, seed=3))
    assert got == pairs(N.erdos_renyi(of.repartition(3), 0.1, seed=3)) and len(set(got)) == len(got)
    assert all(0 <= a < b < (0, 1, 2, 500, 500)[g] for g, a, b in got)
    total, counts = 500 * 499 / 2, Counter(g for g, _, _ in got)
    assert all(abs(counts[g] - total * 0.1) < 4 * (total * 0.09) ** 0.5 for g in (3, 4)) and counts[3] != counts[4]
    assert pairs(N.erdos_renyi(sized(spark, 30), 1.0)) == pairs(N.complete(sized(spark, 30)))
    assert N.erdos_renyi(of, 0.0).count() == 0


def test_sparse_graph_of_a_million(spark):
    n, p = 1_000_000, 2e-7
    edges = N.erdos_renyi(sized(spark, n), p, seed=1)
    assert "Join" not in edges._jdf.queryExecution().toString()
    got, mean = edges.agg(F.count("*").alias("m"), F.count_distinct("src", "dst").alias("k"), F.max("dst").alias("top")).first(), n * (n - 1) / 2 * p
    assert abs(got.m - mean) < 4 * mean**0.5 and got.k == got.m and got.top > 0.99 * n


def test_blocks(spark):
    rows = pairs(N.stochastic_blocks(sized(spark, 301), blocks=3, p_in=0.3, p_out=0.02, seed=2))
    assert len(set(rows)) == len(rows) and all(a < b for _, a, b in rows)
    block = lambda x: x * 3 // 301
    size = Counter(map(block, range(301)))
    held = Counter((block(a), block(b)) for _, a, b in rows)
    for (a, b), k in held.items():
        total, p = (size[a] * (size[a] - 1) / 2, 0.3) if a == b else (size[a] * size[b], 0.02)
        assert abs(k - total * p) < 4 * (total * p * (1 - p)) ** 0.5


def test_trees_are_uniform(spark):
    of = sized(spark, *[4] * 1600)
    rows = pairs(N.tree(of, seed=5))
    trees: dict = {}
    for g, a, b in rows:
        trees.setdefault(g, []).append((a, b))
    counts = Counter(map(tuple, trees.values()))
    assert len(counts) == 16
    # chi-square of 15 degrees of freedom: below 37.7 but once in a thousand
    assert sum((k - 100) ** 2 / 100 for k in counts.values()) < 37.7
    big = sized(spark, 1, 2, 50, 700)
    edges = N.tree(big, seed=1)
    assert Counter(g for g, _, _ in pairs(edges)) == {1: 1, 2: 49, 3: 699}
    assert connect.components(N.nodes(big), edges).select("graph_id", "label").distinct().count() == 4


@pytest.mark.parametrize("degree", [3, 6])
def test_regular(spark, degree):
    ns = (1, 2, 5, 8, 9, 200)
    got = pairs(N.regular(sized(spark, *ns), degree, seed=4))
    assert len(set(got)) == len(got) and all(a < b for _, a, b in got)
    for g, n in enumerate(ns):
        d = min(degree, n - 1)
        n += n * d % 2
        d = min(degree, n - 1)
        counts = Counter(x for h, a, b in got if h == g for x in (a, b))
        assert counts == Counter({x: d for x in range(n)} if d else {})


def test_shuffled_is_a_bijection():
    for total in (1, 2, 5, 64, 1000):
        assert sorted(N._shuffled(np.arange(total), total, 77)) == list(range(total))


def test_preferential(spark):
    ns = (1, 2, 4, 5, 600)
    of = sized(spark, *ns)
    frame = N.preferential(of, 3, seed=2)
    got = pairs(frame)
    assert len(set(got)) == len(got) and got == pairs(N.preferential(of.repartition(2), 3, seed=2))
    for g, n in enumerate(ns):
        m = max(1, min(3, n - 1))
        assert Counter(b for h, _, b in got if h == g) == Counter({x: m for x in range(m, n)} if n > 1 else {})
        assert all(a < b for h, a, b in got if h == g)
    # degrees d in shares of about 2 m (m + 1) / (d (d + 1) (d + 2)), so that a share (m (m + 1)) / (k (k + 1)) has k or more
    degree = Counter(x for h, a, b in got if h == 4 for x in (a, b))
    for k in (4, 6, 10):
        share = sum(d >= k for d in degree.values()) / 600
        assert abs(share - 12 / (k * (k + 1))) < 0.08, k
    assert max(degree.values()) > 25


def test_preferential_in_tasks_and_joins(spark):
    of = sized(spark, 2, 5, 300)
    assert pairs(N.preferential(of, 3, seed=5)) == pairs(N.preferential(of, 3, seed=5, in_task=0)) == pairs(N.preferential(of, 3, seed=5, in_task=500))


def test_preferential_runs_out_of_draws():
    """Edges of node 4 that all draw end 0 repeat, and are told to come back with more draws."""
    v, j, m = np.repeat(np.arange(3, 6), 3), np.tile(np.arange(3), 3), 3
    to, used = N._grown(m, v, j, np.zeros(18), np.arange(0, 18, 2), np.full(9, 2))
    assert to is None and used.tolist() == [0, 0, 0, 0, 2, 2, 0, 2, 2]


def test_small_world(spark):
    ns = (1, 2, 4, 5, 6, 300)
    of = sized(spark, *ns)
    ring, moved = Counter(g for g, _, _ in pairs(N.small_world(of, 4, 0.0))), pairs(N.small_world(of, 4, 0.5, seed=1))
    assert ring == {1: 1, 2: 6, 3: 10, 4: 12, 5: 600} and Counter(g for g, _, _ in moved) == ring and len(set(moved)) == len(moved)
    kept = sum((b - a) % 300 <= 2 or (a - b) % 300 <= 2 for g, a, b in moved if g == 5)
    assert 240 < kept < 360
