"""Graph files and generated graphs."""

import pytest

from weftline.sources import generators as gen
from weftline.sources import readers


def _pairs(edges):
    return {(r.src, r.dst): r.weight for r in edges.collect()}


def test_files(spark, tmp_path):
    (tmp_path / "a.gset").write_text("3 2\n1 2 1\n2 3 -1\n")
    nodes, edges = readers.gset(spark, str(tmp_path / "a.gset"))
    assert nodes.count() == 3 and _pairs(edges) == {(0, 1): 1.0, (1, 2): -1.0}
    (tmp_path / "b.gml").write_text('graph [\n node [ id 1 label "x" ]\n node [ id 2 ]\n node [ id 7 ]\n edge [ source 2 target 1 value 2.5 ]\n edge [\n source 1\n target 7 ]\n]')
    nodes, edges = readers.gml(spark, str(tmp_path / "b.gml"))
    assert {r.node_id for r in nodes.collect()} == {1, 2, 7} and _pairs(edges) == {(1, 2): 2.5, (1, 7): 1.0}
    (tmp_path / "c.graphml").write_text('<graphml><key id="d0" for="edge" attr.name="weight"/><graph><node id="a"/><node id="b"></node><node id="c"/><edge source="a" target="b"><data key="d1">9</data><data key="d0">0.5</data></edge><edge source="c" target="b"/></graph></graphml>')
    nodes, edges = readers.graphml(spark, str(tmp_path / "c.graphml"))
    assert nodes.count() == 3 and _pairs(edges) == {("a", "b"): 0.5, ("b", "c"): 1.0}
    (tmp_path / "d.net").write_text('*Vertices 3\n1 "x"\n2 "y"\n3 "z"\n*Edges\n1 2 4.0\n*Arcs\n3 2\n')
    nodes, edges = readers.pajek(spark, str(tmp_path / "d.net"))
    assert nodes.count() == 3 and _pairs(edges) == {(0, 1): 4.0, (1, 2): 1.0}


def test_generated(spark):
    sized = gen.sizes(spark, 4, 12, 18, seed=5)
    total = sum(r.n for r in sized.collect())
    assert gen.tree(sized, 1).count() == total - 4
    assert gen.small_world(sized, 4, 0.0).count() == 2 * total
    moved = gen.small_world(sized, 4, 0.5, seed=2)
    assert moved.where("src >= dst").count() == 0 and 1.5 * total < moved.count() <= 2 * total
    ends = gen.regular(sized, 4, seed=3)
    degree = ends.select("graph_id", "src").union(ends.select("graph_id", "dst")).groupBy("graph_id", "src").count()
    assert {r["count"] for r in degree.collect()} == {4} and degree.count() == total
    grown = gen.preferential(sized, 3, seed=4)
    assert grown.count() == 3 * (total - 12) == grown.distinct().count() and grown.exceptAll(gen.preferential(sized, 3, seed=4)).count() == 0
    assert gen.hypergraph(sized, 5, 3).where("node_id < 0").count() == 0 and gen.hypergraph(sized, 5, 3).select("graph_id", "hyperedge_id").distinct().count() == 20


def test_folders_of_files(spark, tmp_path):
    """Weights by the first row, formats by suffix, labels as numbers, sizes, and batches of files."""
    at = tmp_path / "nets"
    (at / "below").mkdir(parents=True)
    (at / "a.edges").write_text("# note\n10 9\n9 x 7.5\n")
    (at / "b.csv").write_text("0,1,2.5\n1,2,-1\n")
    (at / "below" / "c.col").write_text("p edge 4 2\ne 1 2\ne 2 3\n")
    (at / "below" / "skip.dat").write_text("0 1\n")
    nodes, edges = readers.load_graphs(spark, str(at))
    name = lambda g: g.rsplit("/", 1)[-1]
    assert sorted((name(r.graph_id), r.node_id, r.label) for r in nodes.collect()) == [("a.edges", 0, "9"), ("a.edges", 1, "10"), ("a.edges", 2, "x"), ("b.csv", 0, "0"), ("b.csv", 1, "1"), ("b.csv", 2, "2"), *[("c.col", k, str(k + 1)) for k in range(4)]]
    assert sorted((name(r.graph_id), r.src, r.dst, r.weight) for r in edges.collect()) == [("a.edges", 0, 1, 1.0), ("a.edges", 0, 2, 1.0), ("b.csv", 0, 1, 2.5), ("b.csv", 1, 2, -1.0), ("c.col", 0, 1, 1.0), ("c.col", 1, 2, 1.0)]
    assert readers.load_graphs(spark, str(at), max_nodes=3)[0].select("graph_id").distinct().count() == 2
    assert readers.load_graph(spark, str(at / "below" / "skip.dat"))[0].count() == 2
    files = readers.FileDataset(spark, str(at))
    drawn = files.sample(5, seed=3)
    assert drawn[0].select("graph_id").distinct().count() == 5 and drawn[1].count() == 10
    assert readers.FileDataset(spark, str(at), mode="all").sample(1)[1].count() == 6
    with pytest.raises(FileNotFoundError):
        readers.load_graphs(spark, str(at / "below"), fmt="auto", max_nodes=1)
