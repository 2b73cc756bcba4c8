"""Graph kernels as compositions of joins, aggregations and windows, keyed by graph_id.

Nodes without edges are kept by a left join from the node table, with zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.connect import components
from weftline.plans.views import both

KEY = ["graph_id", "node_id"]


def _dense(nodes: DataFrame, found: DataFrame, **zero) -> DataFrame:
    """``found`` for every node; columns named in ``zero`` filled where there is none."""
    out = nodes.select(*KEY).join(found, KEY, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zero.items()})


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = both(edges).groupBy("graph_id", F.col("u").alias("node_id")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    return _dense(nodes, found, degree=0, strength=0)


def neighbour_agg(nodes: DataFrame, edges: DataFrame, value: str, **aggs) -> DataFrame:
    """Aggregates of a node column over neighbours, by node; empty neighbourhoods give 0."""
    to = nodes.select("graph_id", F.col("node_id").alias("v"), F.col(value).alias("x"))
    found = both(edges).join(to, ["graph_id", "v"]).groupBy("graph_id", F.col("u").alias("node_id")).agg(*[f.alias(k) for k, f in aggs.items()])
    return _dense(nodes, found, **dict.fromkeys(aggs, 0))


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, components, largest and connected pairs."""
    size = components(nodes, edges).groupBy("graph_id", "label").agg(F.count("*").alias("n"))
    return size.groupBy("graph_id").agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"))


def top_by(scored: DataFrame, score: str, most) -> DataFrame:
    """The ``most`` highest of each graph, ties to the smaller node; ``most`` is a number or a column."""
    order = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.col(score).desc(), "node_id"))
    return scored.withColumn("rank", order).where(F.col("rank") <= most)


def argmax(nodes: DataFrame, scored: DataFrame) -> DataFrame:
    """graph_id and the node of the highest score, -1 where none is legal; a partial aggregate, not a window."""
    best = scored.groupBy("graph_id").agg(F.max_by("node_id", F.struct("score", -F.col("node_id"))).alias("node_id"))
    return nodes.select("graph_id").distinct().join(best, "graph_id", "left").withColumn("node_id", F.coalesce("node_id", F.lit(-1)))


def softmax(scored: DataFrame) -> DataFrame:
    w = Window.partitionBy("graph_id")
    e = F.exp(F.col("score") - F.max("score").over(w))
    return scored.withColumn("e", e).withColumn("p", F.col("e") / (F.sum("e").over(w) + F.lit(1e-16))).drop("e")


def propagate(nodes: DataFrame, edges: DataFrame, value: str, rounds: int, keep: float = 0.0) -> DataFrame:
    """x <- (1 - keep) P x + keep x0 with P the symmetric normalised adjacency with self loops."""
    deg = degree(nodes, edges).select(*KEY, (1 / F.sqrt(F.col("degree") + 1)).alias("c"))
    base = nodes.select(*KEY, F.col(value).cast("double").alias("x0")).join(deg, KEY)
    links = both(edges).select("graph_id", "u", "v")
    x = base.select(*KEY, "c", "x0", F.col("x0").alias("x"))
    for _ in range(rounds):
        sent = x.select("graph_id", F.col("node_id").alias("v"), (F.col("x") * F.col("c")).alias("m"))
        got = links.join(sent, ["graph_id", "v"]).groupBy("graph_id", F.col("u").alias("node_id")).agg(F.sum("m").alias("m"))
        x = x.join(got, KEY, "left").withColumn("x", (1 - keep) * F.col("c") * (F.coalesce("m", F.lit(0.0)) + F.col("c") * F.col("x")) + keep * F.col("x0")).drop("m")
    return x.select(*KEY, "x")


def line_graph(edges: DataFrame) -> DataFrame:
    """Pairs of edges that share an end, as (src, dst) of each."""
    ends = edges.select("graph_id", F.struct("src", "dst").alias("e"), F.explode(F.array("src", "dst")).alias("at"))
    pairs = ends.alias("a").join(ends.alias("b"), (F.col("a.graph_id") == F.col("b.graph_id")) & (F.col("a.at") == F.col("b.at")) & (F.col("a.e") < F.col("b.e")))
    return pairs.select(F.col("a.graph_id"), F.col("a.e.src").alias("src1"), F.col("a.e.dst").alias("dst1"), F.col("b.e.src").alias("src2"), F.col("b.e.dst").alias("dst2")).distinct()


def edge_states(edges: DataFrame, state: DataFrame, column: str) -> DataFrame:
    """Edges with the state of both ends, as a and b."""
    of = state.select("graph_id", "node_id", column)
    return edges.join(of.toDF("graph_id", "src", "a"), ["graph_id", "src"]).join(of.toDF("graph_id", "dst", "b"), ["graph_id", "dst"])


def seed_discount(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """graph_id, node_id, score: degree less the neighbours that are seeds, for nodes that are none."""
    mark = seeds.select("graph_id", F.col("node_id").alias("v")).distinct().withColumn("seed", F.lit(1))
    near = both(edges).join(mark, ["graph_id", "v"], "left").groupBy("graph_id", F.col("u").alias("node_id")).agg(F.count(F.when(F.col("seed").isNull(), 1)).alias("score"))
    return _dense(nodes.join(seeds.select(*KEY), KEY, "left_anti"), near, score=0)


def modularity_delta(nodes: DataFrame, edges: DataFrame, side) -> DataFrame:
    """graph_id, node_id, dq: the change of weighted modularity when a node's side (1 or -1, a column) flips; graphs without edges have none."""
    of = degree(nodes, edges).withColumn("side", side)
    total = of.groupBy("graph_id").agg(F.sum("strength").cast("double").alias("w2"), F.sum(F.col("strength") * F.col("side")).cast("double").alias("ks")).where("w2 > 0")
    field = neighbour_agg(of, edges.select("graph_id", "src", "dst", "weight"), "side", f=F.sum(F.col("weight") * F.col("x")))
    k, x = F.col("strength").cast("double"), F.col("side")
    dq = -2 * x * (F.col("f").cast("double") - k * (F.col("ks") - k * x) / F.col("w2")) / F.col("w2")
    return of.join(field, KEY).join(total, "graph_id").select(*KEY, dq.alias("dq"))


def removal_rewards(nodes: DataFrame, edges: DataFrame, removed: DataFrame, cost: str) -> DataFrame:
    """graph_id, nd, nd_cost, cn: less the largest component over n squared; the same over n by the share of cost removed; less the
    connected pairs over n times all pairs. Graphs of one node have no rewards."""
    gone = removed.select(*KEY).distinct().withColumn("gone", F.lit(1))
    size = nodes.join(gone, KEY, "left").groupBy("graph_id").agg(F.count("*").cast("double").alias("n"), F.sum(cost).cast("double").alias("w"), F.sum(F.when(F.col("gone") == 1, F.col(cost)).otherwise(0)).cast("double").alias("wa"))
    left = connectivity(nodes.join(gone, KEY, "left_anti"), _left_edges(edges, removed))
    n, most, pairs = F.col("n"), F.coalesce("largest", F.lit(0)), F.coalesce("pairs", F.lit(0))
    of = size.where("n > 1").join(left, "graph_id", "left")
    return of.select("graph_id", (-most / (n * n)).alias("nd"), (-most / n * (F.col("wa") / F.col("w"))).alias("nd_cost"), (-pairs / (n * (n * (n - 1) / 2))).alias("cn"))


def _left_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    for end in ("src", "dst"):
        edges = edges.join(removed.select("graph_id", F.col("node_id").alias(end)), ["graph_id", end], "left_anti")
    return edges


def residual_status(edges: DataFrame, left: DataFrame) -> DataFrame:
    """graph_id, covered, nodes, two_hop: edges gone, nodes with an edge left, and paths of two edges left; graphs with edges only."""
    deg = both(left).groupBy("graph_id", "u").agg(F.count("*").alias("k"))
    of = deg.groupBy("graph_id").agg(F.count("*").alias("nodes"), F.sum(F.expr("k * (k - 1) div 2")).alias("two_hop"), (F.sum("k") / 2).cast("long").alias("kept"))
    out = edges.groupBy("graph_id").agg(F.count("*").alias("m")).join(of, "graph_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("graph_id", (F.col("m") - zero("kept")).alias("covered"), zero("nodes").alias("nodes"), zero("two_hop").alias("two_hop"))


def pairs_near(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> DataFrame:
    """graph_id, pairs: pairs of remaining nodes that share a neighbour, removed or not. Neighbours' degrees set its size."""
    ends = both(edges).select("graph_id", F.col("u").alias("at"), F.col("v").alias("node_id")).join(removed.select(*KEY), KEY, "left_anti")
    pairs = ends.withColumnRenamed("node_id", "x").join(ends.withColumnRenamed("node_id", "y"), ["graph_id", "at"]).where("x < y").select("graph_id", "x", "y").distinct()
    of = pairs.groupBy("graph_id").agg(F.count("*").alias("pairs"))
    return nodes.select("graph_id").distinct().join(of, "graph_id", "left").select("graph_id", F.coalesce("pairs", F.lit(0)).alias("pairs"))
