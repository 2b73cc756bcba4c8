"""Typed generators, sinks, the registry and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import registry
from weftline.operators import local as L
from weftline.sources import generators as A
from weftline.sources import more_generators as B
from weftline.sources import sinks
from weftline.streaming import edges as S


@pytest.fixture(scope="module")
def sized(spark):
    return A.sizes(spark, 4, 12, 20, seed=5)


def test_growing(sized):
    size = {r.graph_id: r.n for r in sized.collect()}
    for made, many in ((B.powerlaw_cluster(sized, 3, 0.5), lambda n: 3 * (n - 3)), (B.powerlaw_tree(sized), lambda n: n - 1)):
        rows = made.collect()
        assert all(0 <= r.src < r.dst < size[r.graph_id] for r in rows)
        assert all(sum(r.graph_id == g for r in rows) == many(n) for g, n in size.items())
    for g, n in size.items():
        u = L.Union(n)
        for r in rows:
            if r.graph_id == g:
                u.join(r.src, r.dst)
        assert u.largest == n


def test_typed(spark, sized):
    own, edges = B.heterogeneous(sized, 3, 2, p=0.3)
    assert {r.kind for r in own.collect()} <= {0, 1, 2} and {r.kind for r in edges.collect()} == {0, 1}
    assert B.multiplex(sized, 3, p=0.5).groupBy("kind").count().count() == 3
    sets = B.set_cover(spark, 3)
    assert sets.select("graph_id", "element").distinct().count() == A.sizes(spark, 3, 20, 30).agg(F.sum("n")).first()[0]
    own, edges = B.combat(sized)
    kind = {(r.graph_id, r.node_id): r.kind for r in own.collect()}
    pairs = {0: {0, 1}, 1: {1, 2}, 2: {1}}
    rows = edges.collect()
    assert all({kind[r.graph_id, r.src], kind[r.graph_id, r.dst]} == pairs[r.kind] for r in rows)
    onward = {(r.graph_id, x) for r in rows if r.kind < 2 for x in (r.src, r.dst)}
    assert all(k in onward for k, v in kind.items() if v == 0)
    assert B.caveman(spark, 2, 3, 4, 0.0).count() == 2 * 3 * 6
    own, edges = B.cubic_lattice(spark, 3)
    assert own.count() == 27 and edges.count() == 81 and B.cubic_lattice(spark, 2)[1].count() == 12
    bias, pair = B.qubo_of_matrix(spark.createDataFrame([(0, i, j, float(q)) for i, row in enumerate([[1, 2, 0], [3, 0, 1], [0, -1, 5]]) for j, q in enumerate(row)], "graph_id long, i long, j long, q double"))
    assert [r.bias for r in bias.orderBy("node_id").collect()] == [1, 0, 5] and [(r.src, r.dst, r.weight) for r in pair.collect()] == [(0, 1, 5)]
    own, edges = B.qubo(sized, p=0.4)
    assert edges.where("abs(weight) > 1").count() == 0 and own.where("abs(bias) > 1").count() == 0


def test_sinks(spark, tmp_path):
    order = spark.createDataFrame([(0, k, 10 - k, k / 3) for k in range(5)], "graph_id long, step long, node_id long, share double")
    sinks.solution(order, f"{tmp_path}/s")
    sinks.curve(order, f"{tmp_path}/c")
    text = "".join(f.read_text() for f in sorted((tmp_path / "s" / "graph_id=0").glob("part-*")))
    assert text.split() == ["10", "9", "8", "7", "6"]
    assert "".join(f.read_text() for f in sorted((tmp_path / "c" / "graph_id=0").glob("part-*"))).split()[1] == "0.33333333"
    nodes = spark.createDataFrame([(0, 1, 0.5), (0, 2, 1.0)], "graph_id long, node_id long, weight double")
    sinks.gml(nodes, spark.createDataFrame([(0, 1, 2)], "graph_id long, src long, dst long"), f"{tmp_path}/g")
    text = next((tmp_path / "g" / "graph_id=0").glob("part-*")).read_text()
    assert text.count("node [") == 2 and "source 1" in text and "weight 0.5" in text
    for _ in range(2):
        sinks.metrics(nodes, f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").count() == 4 and nodes.agg(sinks.spread("weight").alias("x")).first().x == "0.75±0.25"


def test_registry(tmp_path):
    r = registry.Registry("thing")
    r.register("One", "uno")(dict)
    with pytest.raises(KeyError):
        r.register("ONE")(list)
    assert r.build({"type": "UNO", "a": 1}) == {"a": 1} and r.get("collections:OrderedDict").__name__ == "OrderedDict"
    (tmp_path / "base.yaml").write_text("a: {b: 1, c: 2}\nname: x\n")
    (tmp_path / "own.yaml").write_text("base: base\na: {c: 3}\npath: out/${name}/${a.b}\n")
    assert registry.load_config(tmp_path / "own.yaml", ["a.b=5", "name=z"]) == {"a": {"b": 5, "c": 3}, "name": "z", "path": "out/z/5"}
    (tmp_path / "loop.yaml").write_text("base: loop\n")
    with pytest.raises(ValueError):
        registry.load_config(tmp_path / "loop.yaml")
    assert registry.instantiate({"_target_": "builtins.dict", "x": [{"_target_": "builtins.int"}]}) == {"x": [0]}
    assert {"gcn", "gat"} <= set(registry.parts()["encoder"].names())


def test_streamed_components(spark, tmp_path):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + k, 101 + k) for k in range(30)]
    for k in range(3):
        spark.createDataFrame(pairs[k::3], "src long, dst long").coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = spark.readStream.schema("src long, dst long").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = S.maintain_components(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination(120)
    assert q.exception() is None
    got = {r.node_id: r.label for r in S.version(spark, f"{tmp_path}/out", 2).collect()}
    want = {x: x for p in pairs for x in p}
    while True:
        before = dict(want)
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
        if before == want:
            break
    assert got == want


def test_streamed_windows(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "2024-01-01 00:10:00"), (1, 3, "2024-01-01 00:50:00"), (1, 2, "2024-01-01 01:10:00")], "src long, dst long, t string").select("src", "dst", F.to_timestamp("t").alias("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = S.windowed_degree(stream).writeStream.format("memory").queryName("degrees").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.node_id, r.degree) for r in spark.table("degrees").collect()) == [(1, 1), (1, 2), (2, 1), (2, 1), (3, 1)]
