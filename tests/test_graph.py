"""Hand-sized graphs with known values."""

import pytest

from weftline.operators import graph as G
from weftline.operators import local as L
from weftline.plans.views import residual
from weftline.sources import generators, readers


@pytest.fixture(scope="module")
def batch(spark):
    """A triangle, and a path of four."""
    nodes = spark.createDataFrame([(0, k) for k in range(3)] + [(1, k) for k in range(4)], "graph_id long, node_id long")
    edges = spark.createDataFrame([(0, 0, 1, 1), (0, 1, 2, 1), (0, 0, 2, 1), (1, 0, 1, 1), (1, 1, 2, 1), (1, 2, 3, 1)], "graph_id long, src long, dst long, weight long")
    return nodes, edges


def test_degree(batch):
    got = [r.degree for r in G.degree(*batch).orderBy("graph_id", "node_id").collect()]
    assert got == [2, 2, 2, 1, 2, 2, 1]


def test_components_keep_isolated_nodes(spark, batch):
    nodes, edges = batch
    gone = spark.createDataFrame([(1, 1)], "graph_id long, node_id long")
    got = {r.graph_id: (r.components, r.largest, r.pairs) for r in G.connectivity(*residual(nodes, edges, gone)).collect()}
    assert got == {0: (1, 3, 3), 1: (2, 2, 1)}


def test_argmax_ties_and_none(spark, batch):
    scored = spark.createDataFrame([(0, 1, 0.5), (0, 0, 0.5)], "graph_id long, node_id long, score double")
    assert {r.graph_id: r.node_id for r in G.argmax(batch[0], scored).collect()} == {0: 0, 1: -1}


def test_robustness_of_star_and_path():
    star = L.neighbours(4, *map(__import__("numpy").array, ([0, 0, 0], [1, 2, 3])))
    curve = L.dismantling_curve([0, 1, 2, 3], star)
    assert sum(c[0] for c in curve[1:4]) / 16 == 3 / 16 and sum(c[1] for c in curve[1:4]) == 0
    path = L.neighbours(4, *map(__import__("numpy").array, ([0, 1, 2], [1, 2, 3])))
    curve = L.dismantling_curve([1, 0, 2, 3], path)
    assert [c[0] / 4 for c in curve[:4]] == [1, 0.5, 0.5, 0.25]
    assert sum(c[0] for c in curve[1:4]) / 16 == 5 / 16 and sum(c[1] for c in curve[1:4]) / 6 / 4 == 1 / 12


def test_readers(spark, tmp_path):
    (tmp_path / "a.edges").write_text("# note\n0 1 2.5\n1,2 -1.0\n2 2\n1 0\n")
    got = {(r.src, r.dst): r.weight for r in readers.edge_list(spark, str(tmp_path / "a.edges")).collect()}
    assert set(got) == {("0", "1"), ("1", "2")} and got["0", "1"] == 2.5
    (tmp_path / "b.col").write_text("c x\np edge 3 2\ne 1 2\ne 2 3\n")
    nodes, edges = readers.dimacs(spark, str(tmp_path / "b.col"))
    assert nodes.count() == 3 and edges.count() == 2
    (tmp_path / "c.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n3 3 3\n2 1 1\n3 1 1\n3 2 1\n")
    assert readers.matrix_market(spark, str(tmp_path / "c.mtx")).count() == 3
    assert readers.detect("x.clq.gz") == "dimacs"


def test_generators(spark):
    sized = generators.sizes(spark, 6, 10, 20, seed=3)
    assert all(10 <= r.n <= 20 for r in sized.collect())
    full = generators.complete(sized).count()
    some = generators.erdos_renyi(sized, 0.3, seed=1)
    assert 0.1 * full < some.count() < 0.5 * full
    assert some.exceptAll(generators.erdos_renyi(sized, 0.3, seed=1)).count() == 0
    assert generators.lattice(spark, 4).count() == 32
    brute = generators.geometric(sized, 1.5, seed=2).count()
    assert brute == full


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
