"""Every encoder: the same for relabelled graphs, finite on bare and empty ones; the joins agree with the numpy form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import encoders as E
from weftline.operators import graph as G


def sample(seed, n=9):
    rng = np.random.default_rng(seed)
    a, b = np.triu_indices(n, 1)
    on = rng.random(len(a)) < 0.35
    a, b = a[on], b[on]
    w, kind = rng.random(len(a)), rng.integers(0, 2, len(a))
    member = rng.integers(0, n, 12)
    return E.Graph(n, np.r_[a, b], np.r_[b, a], np.r_[w, w], np.r_[kind, kind], rng.integers(0, 2, n), member, np.arange(12) // 3), rng.random((n, 5))


def relabelled(g, x, p):
    back = np.argsort(p)
    return E.Graph(g.n, p[g.src], p[g.dst], g.weight, g.kind, g.node_kind[back], p[g.member], g.hyperedge), x[back]


@pytest.mark.parametrize("kind", sorted(E.ENCODERS))
def test_equivariant(kind):
    g, x = sample(2)
    p = np.random.default_rng(9).permutation(g.n)
    h = E.ENCODERS[kind](g, x, E.Weights(1), 8, 2)
    other = E.ENCODERS[kind](*relabelled(g, x, p), E.Weights(1), 8, 2)
    assert h.shape == (g.n, 8) and np.isfinite(h).all() and h.std() > 0
    assert np.allclose(h, other[p], atol=1e-9)
    none = np.zeros(0, int)
    for n in (0, 3):
        bare = E.Graph(n, none, none, np.zeros(0), none, np.zeros(n, int))
        assert np.isfinite(E.ENCODERS[kind](bare, np.ones((n, 5)), E.Weights(1), 8, 2)).all()


def test_encode_matches_joins(spark):
    nodes = spark.createDataFrame([(0, k, float(k)) for k in range(5)] + [(1, 7, 2.0)], "graph_id long, node_id long, v double")
    edges = spark.createDataFrame([(0, 0, 1, 1), (0, 1, 2, 1), (0, 2, 3, 1)], "graph_id long, src long, dst long, weight long")
    want = {(r.graph_id, r.node_id): r.x for r in G.propagate(nodes, edges, "v", 2).collect()}
    got = E.encode(nodes.select("graph_id", "node_id", F.array("v").alias("x")), edges, "sgc", 1, 2, given={"in": [[1.0]]}).collect()
    assert {(r.graph_id, r.node_id): pytest.approx(r.h[0]) for r in got} == want
    with pytest.raises(ValueError):
        E.encode(nodes.withColumn("x", F.array("v")), edges, "nope")


def test_messages_in_blocks(monkeypatch):
    """Messages sent some edges at a time add up to the last digit to those sent at once."""
    rng = np.random.default_rng(6)
    src, dst, factor, h = rng.integers(0, 9, 50), rng.integers(0, 9, 50), rng.random((50, 1)), rng.random((9, 4))
    g = E.Graph(9, src, dst, np.ones(50), np.zeros(50, int), np.zeros(9, int))
    monkeypatch.setattr(E, "AT_ONCE", 7)
    assert np.array_equal(g.sent(h, factor), g.total(h[src] * factor))
    assert np.array_equal(g.sent(h, None, dst, src, 12), g.total(h[dst], src, 12))
