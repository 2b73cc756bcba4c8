"""Rewards, residual states and move values on hand-sized graphs; marked-up text."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import graph as G
from weftline.plans.views import residual


@pytest.fixture(scope="module")
def batch(spark):
    """A star of four around 0, and a path of four; node 9 stands alone in a third graph."""
    nodes = spark.createDataFrame([("s", k, k + 1) for k in range(4)] + [("p", k, 1) for k in range(4)] + [("i", 9, 1)], "graph_id string, node_id long, cost long")
    edges = spark.createDataFrame([("s", 0, k, 1) for k in (1, 2, 3)] + [("p", k, k + 1, 1) for k in range(3)], "graph_id string, src long, dst long, weight long")
    return nodes, edges


@pytest.fixture(scope="module")
def removed(spark):
    return spark.createDataFrame([("s", 0), ("p", 1)], "graph_id string, node_id long")


def test_removal_rewards(batch, removed):
    got = {r.graph_id: (r.nd, r.nd_cost, r.cn) for r in G.removal_rewards(*batch, removed, "cost").collect()}
    assert got["s"] == (-1 / 16, pytest.approx(-1 / 4 * 1 / 10), 0)
    assert got["p"] == (-2 / 16, pytest.approx(-2 / 4 * 1 / 4), pytest.approx(-1 / 24))
    assert "i" not in got


def test_everything_removed(batch):
    nodes, edges = batch
    got = {r.graph_id: (r.nd, r.cn) for r in G.removal_rewards(nodes, edges, nodes, "cost").collect()}
    assert got == {"s": (0, 0), "p": (0, 0)}


def test_residual_status(batch, removed):
    nodes, edges = batch
    left = residual(nodes, edges, removed)[1]
    got = {r.graph_id: (r.covered, r.nodes, r.two_hop) for r in G.residual_status(edges, left).collect()}
    assert got == {"s": (3, 0, 0), "p": (2, 2, 0)}


def test_pairs_near_counts_removed_neighbours(batch, removed):
    got = {r.graph_id: r.pairs for r in G.pairs_near(*batch, removed).collect()}
    assert got == {"s": 3, "p": 1, "i": 0}


def test_seed_discount(batch, removed):
    got = {(r.graph_id, r.node_id): r.score for r in G.seed_discount(*batch, removed).collect()}
    assert got == {("s", 1): 0, ("s", 2): 0, ("s", 3): 0, ("p", 0): 0, ("p", 2): 1, ("p", 3): 1, ("i", 9): 0}


def test_modularity_delta_is_the_difference(batch):
    nodes, edges = batch
    links = [(0, 1), (1, 2), (2, 3)]

    def q(side):
        k = [sum(v in e for e in links) for v in range(4)]
        near = lambda a, b: ((a, b) in links or (b, a) in links) - k[a] * k[b] / 6
        return sum(near(a, b) * side[a] * side[b] for a in range(4) for b in range(4)) / 12

    side = [1 - 2 * (v % 2) for v in range(4)]
    got = {r.node_id: r.dq for r in G.modularity_delta(nodes, edges, 1 - 2 * (F.col("node_id") % 2)).where("graph_id = 'p'").collect()}
    for v in range(4):
        flipped = [-s if u == v else s for u, s in enumerate(side)]
        assert got[v] == pytest.approx(q(flipped) - q(side))


def test_inline_html_and_digits(spark):
    rows = [("a **b c** <d> `e f` & **g\nh**",), ("12",), ("",), ("1 2",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(S.inline_html(F.col("t")).alias("h"), S.all_digits(F.col("t")).alias("d")).collect()
    assert got[0].h == "a <b>b c</b> &lt;d&gt; <code>e f</code> &amp; **g\nh**"
    assert [r.d for r in got] == [False, True, False, False, None] and got[4].h is None
