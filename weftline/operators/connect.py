"""Connectivity of graphs of any size, in joins: components, what stays connected along a removal order, mutual components.

``tree`` is the core, a Borůvka forest. Every edge has a time, the larger the longer it lives. In a round each root
picks its longest-living edge, picks are followed to the root that they lead to, and edges move to the roots. A root's
link is written with the time of its pick. As picks only get longer along the way to a root, any end of an edge that leaves
a tree is connected to the tree's root for as long as the edge lives; so edges may move, and at every time the
links that still live connect just what the edges do.

``removal_curve`` gives the largest component and the connected pairs after every removal from one such tree, with no
pass a prefix. Read backwards, removals are merges. Times are halved again and again: links of the later half of a
block merge first, and are followed to the top of each piece; links of the earlier half then join pieces, of summed size. After as
many halvings as times have bits, every link knows the sizes that meet at its time.

Each round is written to the shared folder, so that lineage stays short. Rounds are logarithmic in the number of nodes, rows of a round at most those of the edges.
A hub's edges are one key in the joins of a round, on one side only, which adaptive execution splits.

Defined results: edges listed twice or in both directions count once; loops and edges with a null end or an end that is no node are left out; isolated
nodes are components of one; a null graph_id is no graph, its rows are left out; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.local import Union, per_graph
from weftline.scratch import Rounds, zero

#: Rows of a graph that one task sums up in order, as a power of two.
STRIPE = 16
#: Edges of the largest graph that one task holds; of larger ones no task sees more than a part.
IN_TASK = 1_000_000


def _resolve(links: DataFrame, keys: list[str], rounds: Rounds) -> DataFrame:
    """keys, u, up: each link followed to where no link leads on; paths halve three times a round, the last of which tells whether any is left."""

    def leap(at: DataFrame) -> DataFrame:
        on = at.select(*keys, F.col("u").alias("up"), F.col("up").alias("far"))
        return at.join(on, [*keys, "up"], "left").select(*keys, "u", F.coalesce("far", "up").alias("up"), F.col("far").isNotNull().alias("moved"))

    return rounds.settle(links.select(*keys, "u", "up"), lambda at: reduce(lambda now, _: leap(now), range(3), at), F.col("moved")).drop("moved")


def _known(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges without loops whose ends are nodes."""
    ids = nodes.select("graph_id", "node_id").distinct()
    kept = edges.where("src != dst")
    for end in ("src", "dst"):
        kept = kept.join(ids.withColumnRenamed("node_id", end).hint("merge"), ["graph_id", end], "left_semi")  # as many rows as nodes, which the driver should not gather
    return kept


def tree(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """graph_id, node_id, parent, time: links that connect at every time what ``edges`` (graph_id, src, dst, time) connect; roots have none."""
    pair = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    merged = lambda e: e.where("u != v").groupBy("graph_id", *pair).agg(F.max("time").alias("time"))
    left, n = rounds.counted(merged(edges.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v"), "time")), F.lit(1))
    found = []
    while n:
        way = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("w")
        seen = left.select("graph_id", "time", F.col("u").alias("a"), F.col("v").alias("b"), way).select("graph_id", "w.u", "w.v", "time", "a", "b")
        # equal times are told apart by the ends, the same from both sides, so that picks make no rings
        best = seen.groupBy("graph_id", "u").agg(F.max_by(F.struct("v", "time"), F.struct("time", "a", "b")).alias("x"))
        picks = rounds.put(best.select("graph_id", "u", F.col("x.v").alias("up"), "x.time"))
        back = picks.select("graph_id", F.col("u").alias("up"), F.col("up").alias("back"))
        up = picks.join(back, ["graph_id", "up"]).where((F.col("back") != F.col("u")) | (F.col("u") > F.col("up")))
        links = up.select("graph_id", "u", "up", "time")
        found.append(links.select("graph_id", F.col("u").alias("node_id"), F.col("up").alias("parent"), "time"))
        to = _resolve(links, ["graph_id"], rounds)
        moved = left
        for end in ("u", "v"):
            moved = moved.join(to.select("graph_id", F.col("u").alias(end), F.col("up").alias("to")), ["graph_id", end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
        new, n = rounds.counted(merged(moved), F.lit(1))
        rounds.drop(left)
        left = new
    kinds = [left.select("graph_id", F.col("u").alias("node_id"), F.col("v").alias("parent"), "time").limit(0)]
    return reduce(DataFrame.unionByName, found or kinds)


def _labelled(ids, src, dst, weight):
    """Kernel: the largest node of each node's component, by union-find."""
    u = Union(len(ids))
    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        u.join(a, b)
    roots = [u.root(k) for k in range(len(ids))]
    top = {r: int(ids[k]) for k, r in enumerate(roots)}
    return ((int(ids[k]), top[r]) for k, r in enumerate(roots))


def components(nodes: DataFrame, edges: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """graph_id, node_id, label: the largest node id of the component.

    Graphs of at most ``in_task`` edges, as many as there are, are labelled one in a task; larger ones, of any size, in joins. Labels are the same either way.
    """
    rounds = Rounds(nodes.sparkSession, "components")
    every = nodes.select("graph_id", "node_id").where("graph_id is not null and node_id is not null").distinct()
    ends = rounds.put(_known(every, edges).select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    large, n = rounds.counted(ends.groupBy("graph_id").agg(F.count("*").alias("m")).where(F.col("m") > in_task).select("graph_id"), F.lit(1))
    in_one = lambda t: t.join(large, "graph_id", "left_anti") if n else t
    small = per_graph(in_one(every), in_one(ends).withColumn("weight", F.lit(1.0)), _labelled, f"graph_id {dict(nodes.dtypes)['graph_id']}, node_id long, label long")
    if not n:
        return small
    every, ends = rounds.put(every.join(large, "graph_id", "left_semi")), ends.join(large, "graph_id", "left_semi")
    links = tree(ends.withColumn("time", F.lit(0)), rounds)
    to = _resolve(links.select("graph_id", F.col("node_id").alias("u"), F.col("parent").alias("up")), ["graph_id"], rounds)
    rooted = every.join(to.withColumnRenamed("u", "node_id"), ["graph_id", "node_id"], "left").withColumn("up", F.coalesce("up", "node_id"))
    top = rooted.groupBy("graph_id", "up").agg(F.max("node_id").alias("label"))
    return small.unionByName(rooted.join(top, ["graph_id", "up"]).select("graph_id", "node_id", "label"))


def _merges(links: DataFrame, bits: int, rounds: Rounds) -> DataFrame:
    """graph_id, time, size, pairs: every piece that forms at a time, and the pairs of nodes that it newly connects.

    ``links``: graph_id, c, p, time; a node has one link up at most.
    """
    one = F.lit(1).cast("long")
    state = rounds.put(links.select("graph_id", "time", "c", one.alias("sc"), "p", one.alias("sp")))

    def pieces(late: DataFrame, block: Column) -> tuple[DataFrame, DataFrame]:
        to = _resolve(late.select("graph_id", block.alias("block"), F.col("c").alias("u"), F.col("p").alias("up")), ["graph_id", "block"], rounds)
        of = late.withColumn("block", block).join(to.withColumnsRenamed({"u": "c", "up": "top"}), ["graph_id", "block", "c"])
        base = F.max(F.when(F.col("p") == F.col("top"), F.col("sp")))
        return to, of.groupBy("graph_id", "block", "top").agg((F.sum("sc") + base).alias("size"), (F.sum(F.col("sc") * F.col("sc")) + base * base).alias("squares"))

    for bit in reversed(range(bits)):
        block = F.shiftright("time", bit + 1)
        later = F.shiftright("time", bit).bitwiseAND(F.lit(1)) == 1
        to, of = pieces(state.where(later), block)
        early = state.where(~later).withColumn("block", block)
        early = early.join(of.select("graph_id", "block", F.col("top").alias("c"), F.col("size").alias("grown")), ["graph_id", "block", "c"], "left").withColumn("sc", F.coalesce("grown", "sc")).drop("grown")
        early = early.join(to.withColumnsRenamed({"u": "p", "up": "top"}), ["graph_id", "block", "p"], "left").withColumn("p", F.coalesce("top", "p")).drop("top")
        early = early.join(of.select("graph_id", "block", F.col("top").alias("p"), F.col("size").alias("grown")), ["graph_id", "block", "p"], "left").withColumn("sp", F.coalesce("grown", "sp"))
        new = rounds.put(state.where(later).unionByName(early.select(*state.columns)))
        rounds.drop(state, to)
        state = new
    _, of = pieces(state, F.col("time"))
    return of.select("graph_id", F.col("block").alias("time"), "size", F.expr("(size * size - squares) div 2").alias("pairs"))


def _downward(rows: DataFrame, order: list[str], **aggs: tuple[str, str]) -> DataFrame:
    """Running aggregates (function, column) of a graph's rows from the last ``at`` down, in stripes, so that no task sees a whole graph."""
    rows = rows.withColumn("stripe", F.shiftright("at", STRIPE))
    call = {"sum": F.sum, "max": F.max}
    sums = rows.groupBy("graph_id", "stripe").agg(*[call[f](c).alias(k) for k, (f, c) in aggs.items()])
    above = Window.partitionBy("graph_id").orderBy(F.desc("stripe")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("graph_id", "stripe", *[call[f](k).over(above).alias(f"{k}_above") for k, (f, _) in aggs.items()])
    within = Window.partitionBy("graph_id", "stripe").orderBy(F.desc("at"), *order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({k: call[f](c).over(within) for k, (f, c) in aggs.items()}).join(sums, ["graph_id", "stripe"])
    both = {"sum": lambda k: zero(k) + zero(f"{k}_above"), "max": lambda k: F.greatest(k, f"{k}_above")}
    return rows.withColumns({k: both[f](k) for k, (f, _) in aggs.items()}).drop("stripe", *[f"{k}_above" for k in aggs])


def _curves(life: DataFrame, edges: DataFrame) -> DataFrame:
    """``removal_curve`` of graphs of which each fits in a task, by union-find from the last time back. ``life``: graph_id, node_id, life, step."""
    kind = dict(life.dtypes)["graph_id"]

    def run(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids, lives = pd.Index(n["node_id"]), n["life"].to_numpy(np.int64)
        a, b = ids.get_indexer(e["src"]), ids.get_indexer(e["dst"])
        on = (a >= 0) & (b >= 0)
        a, b = a[on], b[on]
        time = np.minimum(lives[a], lives[b])
        at = np.argsort(-time, kind="stable")
        asked = np.unique(np.r_[0, n["step"].dropna().to_numpy(np.int64) + 1])[::-1]
        ends = np.searchsorted(-time[at], -asked, side="right").tolist()
        a, b, u, done, largest, pairs = a[at].tolist(), b[at].tolist(), Union(len(ids)), 0, [], []
        for end in ends:
            for k in range(done, end):
                u.join(a[k], b[k])
            done = end
            largest.append(u.largest)
            pairs.append(u.pairs)
        out = pd.DataFrame({"removed": asked, "largest": np.maximum(largest, asked <= lives.max()), "pairs": pairs})
        out.insert(0, "graph_id", key[0])
        return out

    own = edges.join(life.select("graph_id").distinct(), "graph_id", "left_semi")
    return life.groupBy("graph_id").cogroup(own.groupBy("graph_id")).applyInPandas(run, f"graph_id {kind}, removed long, largest long, pairs long")


def removal_curve(nodes: DataFrame, edges: DataFrame, order: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """graph_id, removed, largest, pairs: largest component and connected pairs of nodes once all of a step at most ``removed - 1`` are gone; 0 is the whole graph.

    ``order``: graph_id, node_id, step, from 0. Nodes of one step go together; nodes without a step stay. One row for each step and one for none.
    Graphs of at most ``in_task`` edges, as many as there are, take a task each; larger ones, of any size, take joins.
    """
    rounds = Rounds(nodes.sparkSession, "curve")
    edges = rounds.put(edges.where("src != dst").select("graph_id", "src", "dst"))
    large, n_large = rounds.counted(edges.groupBy("graph_id").agg(F.count("*").alias("m")).where(F.col("m") > in_task).select("graph_id"), F.lit(1))
    every = nodes.select("graph_id", "node_id").where("graph_id is not null and node_id is not null").distinct()
    steps = order.where("step is not null").groupBy("graph_id", "node_id").agg(F.min("step").cast("long").alias("step"))
    ends = steps.groupBy("graph_id").agg((F.max("step") + 1).alias("never"))
    life = rounds.put(every.join(steps, ["graph_id", "node_id"], "left").join(ends, "graph_id", "left").select("graph_id", "node_id", F.coalesce("step", "never", F.lit(0)).alias("life"), "step"))
    in_one = lambda t: t.join(large, "graph_id", "left_anti") if n_large else t
    small = _curves(in_one(life), in_one(edges))
    if not n_large:
        return small
    every, life, steps, timed = (t.join(large, "graph_id", "left_semi") for t in (every, life, steps, edges))
    for end in ("src", "dst"):
        timed = timed.join(life.select("graph_id", F.col("node_id").alias(end), F.col("life").alias(f"life_{end}")), ["graph_id", end])
    links = rounds.put(tree(timed.select("graph_id", "src", "dst", F.least("life_src", "life_dst").alias("time")), rounds).select("graph_id", F.col("node_id").alias("c"), F.col("parent").alias("p"), "time"))
    bits = int(life.agg(F.max("life")).first()[0] or 0).bit_length()
    merges = _merges(links, bits, rounds).groupBy("graph_id", "time").agg(F.max("size").alias("size"), F.sum("pairs").alias("new"))
    alive = life.groupBy("graph_id", F.col("life").alias("time")).agg(F.count("*").alias("held"))
    asked = steps.select("graph_id", (F.col("step") + 1).alias("at")).union(every.select("graph_id", F.lit(0).cast("long"))).distinct()
    gained = alive.join(merges, ["graph_id", "time"], "full").select("graph_id", F.col("time").alias("at"), zero("held").alias("held"), F.greatest(F.coalesce("size", F.lit(0)), (zero("held") > 0).cast("long")).alias("size"), zero("new").alias("new"), F.lit(0).alias("ask"))
    zeros = [F.lit(0).cast("long").alias(c) for c in ("held", "size", "new")]
    rows = gained.unionByName(asked.select("graph_id", "at", *zeros, F.lit(1).alias("ask")))
    summed = _downward(rows, ["ask"], largest=("max", "size"), pairs=("sum", "new"))
    return small.unionByName(summed.where("ask = 1").select("graph_id", F.col("at").alias("removed"), "largest", "pairs"))


def robustness(nodes: DataFrame, edges: DataFrame, order: DataFrame) -> DataFrame:
    """graph_id, n, nd, cn: sums of the curve after the first to the last removal but one, over n squared and over n times all pairs, for an order of all nodes one by one."""
    size = nodes.groupBy("graph_id").agg(F.count_distinct("node_id").alias("n"))
    curve = removal_curve(nodes, edges, order).join(size, "graph_id").where("removed >= 1 and removed < n")
    sums = curve.groupBy("graph_id").agg(F.sum("largest").alias("l"), F.sum("pairs").alias("p"))
    n = F.col("n").cast("double")
    share = lambda c, by: F.coalesce(F.col(c) / by, F.lit(0.0))
    most = F.when(F.col("n") > 1, n * (n - 1) / 2).otherwise(1.0)
    return size.join(sums, "graph_id", "left").select("graph_id", "n", share("l", n * n).alias("nd"), share("p", most * n).alias("cn"))


def cost_robustness(nodes: DataFrame, edges: DataFrame, order: DataFrame, cost: str) -> DataFrame:
    """graph_id, nd_cost, cn_cost: the curve after every removal, as a share of nodes and of pairs, weighted by the share of all cost that the removed node has; for an order of all nodes one by one."""
    of = nodes.groupBy("graph_id").agg(F.count_distinct("node_id").cast("double").alias("n"), F.sum(cost).cast("double").alias("w"))
    paid = order.join(nodes.select("graph_id", "node_id", F.col(cost).cast("double").alias("paid")), ["graph_id", "node_id"]).select("graph_id", (F.col("step") + 1).alias("removed"), "paid")
    n, share = F.col("n"), F.try_divide(F.col("paid"), F.col("w"))
    pairs = F.when(n > 1, F.col("pairs") / (n * (n - 1) / 2)).otherwise(0.0)
    sums = removal_curve(nodes, edges, order).join(paid, ["graph_id", "removed"]).join(of, "graph_id")
    return sums.groupBy("graph_id").agg(F.sum(F.col("largest") / n * share).alias("nd_cost"), F.sum(pairs * share).alias("cn_cost"))


def mutual_components(nodes: DataFrame, layers: DataFrame) -> DataFrame:
    """graph_id, node_id, label: the largest node id of the largest sets of nodes that are connected within themselves in every layer.

    ``layers``: graph_id, layer, src, dst. Starting from one set a graph, each round labels the components of every layer within the sets so far, and nodes
    stay together that agree in all labels, until no set splits. A node without edges in a layer is alone.
    """
    rounds = Rounds(nodes.sparkSession, "mutual")
    every = rounds.put(nodes.select("graph_id", "node_id").where("graph_id is not null and node_id is not null").distinct())
    ends = rounds.put(layers.where("src != dst").select("graph_id", "layer", "src", "dst").distinct())
    names = [r[0] for r in ends.select("layer").distinct().orderBy("layer").collect()]  # layers are few; they are the columns of a node's labels
    groups = rounds.put(every.withColumn("set", F.lit(0).cast("long")))
    sets = groups.select("graph_id", "set").distinct().count()
    while True:
        inner = ends
        for end in ("src", "dst"):
            inner = inner.join(groups.select("graph_id", F.col("node_id").alias(end), F.col("set").alias(f"set_{end}")), ["graph_id", end])
        inner = rounds.put(inner.where("set_src = set_dst").select("graph_id", "layer", "src", "dst"))
        split = groups
        for k, name in enumerate(names):
            own = components(every, inner.where(F.col("layer") == name)).withColumnRenamed("label", f"label{k}")
            split = split.join(own, ["graph_id", "node_id"])
        by = ["graph_id", "set", *[f"label{k}" for k in range(len(names))]]
        top = split.groupBy(*by).agg(F.max("node_id").alias("top"))
        new = rounds.put(split.join(top, by).select("graph_id", "node_id", F.col("top").alias("set")))
        now = new.select("graph_id", "set").distinct().count()
        rounds.drop(groups, inner)
        groups = new
        if now == sets or not names:
            return groups.select("graph_id", "node_id", F.col("set").alias("label"))
        sets = now
