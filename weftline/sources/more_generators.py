"""Typed, layered and structured random graphs. Draws are hashes, as in ``generators``, but for sequential growth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.generators import _simple, draw, erdos_renyi, nodes, preferential, sizes, tree

EDGE = "graph_id long, src long, dst long, weight double"


def _one_task_each(sized: DataFrame, grow, seed: int) -> DataFrame:
    """``grow(n, rng)`` gives a graph's (src, dst) pairs."""

    def run(batches):
        for batch in batches:
            for graph, n in batch[["graph_id", "n"]].itertuples(index=False):
                pairs = sorted({(min(a, b), max(a, b)) for a, b in grow(int(n), np.random.default_rng([seed, int(graph)])) if a != b})
                yield pd.DataFrame([(graph, a, b, 1.0) for a, b in pairs], columns=["graph_id", "src", "dst", "weight"])

    return sized.select("graph_id", "n").mapInPandas(run, EDGE)


def powerlaw_cluster(sized: DataFrame, m: int = 4, p: float = 0.1, seed: int = 0) -> DataFrame:
    """Preferential attachment in which a link closes a triangle with probability ``p``."""

    def grow(n, rng):
        k = min(max(m, 1), max(n - 1, 1))
        ends, near, pairs = list(range(min(k, n))), {x: set() for x in range(n)}, []
        for x in range(k, n):
            last = None
            while len(near[x]) < k:
                open_ = sorted(near[last] - near[x] - {x}) if last is not None and rng.random() < p else []
                y = open_[int(rng.integers(len(open_)))] if open_ else ends[int(rng.integers(len(ends)))]
                if y in near[x]:
                    continue
                near[x].add(y)
                near[y].add(x)
                pairs.append((y, x))
                ends.append(y)
                last = y
            ends += [x] * k
        return pairs

    return _one_task_each(sized, grow, seed)


def powerlaw_tree(sized: DataFrame, gamma: float = 3.0, seed: int = 0) -> DataFrame:
    """A tree whose degrees are drawn from a power law and evened to its 2 (n - 1) ends, built by leaf sequence."""

    def grow(n, rng):
        if n < 2:
            return []
        extra = np.minimum(((1 - rng.random(n)) ** (-1 / (gamma - 1))).astype(int) - 1, n - 2)
        order = [x for x in rng.permutation(n).tolist() for _ in range(extra[x])][: n - 2]
        code = order + rng.integers(0, n, max(n - 2 - len(order), 0)).tolist()
        rng.shuffle(code)
        left = np.bincount(code, minlength=n) + 1
        pairs = []
        for x in code:
            leaf = int(np.argmax(left == 1))
            pairs.append((leaf, x))
            left[leaf] -= 1
            left[x] -= 1
        a, b = np.nonzero(left == 1)[0][:2]
        return [*pairs, (int(a), int(b))]

    return _one_task_each(sized, grow, seed)


def caveman(spark: SparkSession, graphs: int, cliques: int, size: int = 5, p: float = 0.1, seed: int = 0) -> DataFrame:
    """Cliques some of whose edges lead to any node instead."""
    total = cliques * size
    at = spark.range(graphs * total).select(F.floor(F.col("id") / total).alias("graph_id"), (F.col("id") % total).alias("u"))
    inner = at.select("graph_id", "u", F.explode(F.sequence(F.lit(1), F.lit(size - 1))).alias("j")).where((F.col("u") % size) + F.col("j") < size)
    far = F.floor(draw(seed, "graph_id", "u", "j", F.lit("to")) * total)
    to = F.when(draw(seed, "graph_id", "u", "j", F.lit("move")) < p, far).otherwise(F.col("u") + F.col("j"))
    return _simple(inner.select("graph_id", "u", to.alias("v")))


def _kind(seed: int, many: int, *keys: str | Column) -> Column:
    return F.floor(draw(seed, *keys, F.lit("kind")) * many).cast("long")


def heterogeneous(sized: DataFrame, node_kinds: int = 3, edge_kinds: int = 3, base=erdos_renyi, seed: int = 0, **how) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a base graph with uniform kinds."""
    return nodes(sized).withColumn("kind", _kind(seed, node_kinds, "graph_id", "node_id")), base(sized, seed=seed, **how).withColumn("kind", _kind(seed, edge_kinds, "graph_id", "src", "dst"))


def multiplex(sized: DataFrame, layers: int = 2, base=erdos_renyi, seed: int = 0, **how) -> DataFrame:
    """Independent layers over one node set; a pair may be in several. ``kind`` is the layer."""
    out = base(sized, seed=seed, **how).withColumn("kind", F.lit(0).cast("long"))
    for k in range(1, layers):
        out = out.unionByName(base(sized, seed=seed + 7919 * k, **how).withColumn("kind", F.lit(k).cast("long")))
    return out


def set_cover(spark: SparkSession, graphs: int, elements: tuple[int, int] = (20, 30), sets: int | None = None, size: int = 4, seed: int = 0) -> DataFrame:
    """graph_id, set_id, element: sets of drawn elements; an element in none is given to a drawn set, so all can be covered."""
    sized = sizes(spark, graphs, *elements, seed=seed).withColumn("m", F.lit(sets).cast("long") if sets else F.greatest(F.lit(2), F.floor(F.col("n") / 2)))
    each = sized.select("graph_id", "n", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("set_id")).select("*", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("j"))
    member = each.select("graph_id", "set_id", F.floor(draw(seed, "graph_id", "set_id", "j") * F.col("n")).alias("element")).distinct()
    every = sized.select("graph_id", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("element"))
    rest = every.join(member, ["graph_id", "element"], "left_anti")
    return member.unionByName(rest.select("graph_id", F.floor(draw(seed, "graph_id", "element", F.lit("rest")) * F.col("m")).alias("set_id"), "element"))


def combat(sized: DataFrame, shares: tuple[float, float] = (0.4, 0.3), p: tuple[float, float, float] = (0.25, 0.25, 0.1), seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Sensors (kind 0), deciders (1), actors (2); links sense 0, order 1, share 2. Each sensor and decider has a link onward."""
    first, second = (F.greatest(F.lit(1), F.floor(F.col("n") * s)) for s in shares)
    role = sized.withColumn("s", first).withColumn("d", second)
    own = role.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("node_id"))
    own = own.withColumn("kind", F.when(F.col("node_id") < F.col("s"), 0).when(F.col("node_id") < F.col("s") + F.col("d"), 1).otherwise(2).cast("long"))

    def links(of: int, lo: Column, hi: Column, rate: float, kind: int, forced: bool) -> DataFrame:
        to = own.where(F.col("kind") == of).where(hi >= lo).select("graph_id", F.col("node_id").alias("u"), lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(lo, hi)).alias("v"))
        hit = draw(seed, "graph_id", "u", "v", F.lit(f"link{kind}")) < rate
        one = F.col("lo") + F.floor(draw(seed, "graph_id", "u", F.lit(f"forced{kind}")) * (F.col("hi") - F.col("lo") + 1))
        return to.where(hit | (F.col("v") == one) if forced else hit).where("u != v").select("graph_id", "u", "v", F.lit(kind).cast("long").alias("kind"))

    s, d, n = F.col("s"), F.col("d"), F.col("n")
    every = links(0, s, s + d - 1, p[0], 0, True).unionByName(links(1, s + d, n - 1, p[1], 1, True)).unionByName(links(1, s, s + d - 1, p[2], 2, False))
    edges = every.select("graph_id", F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"), F.lit(1.0).alias("weight"), "kind").distinct()
    return own.select("graph_id", "node_id", "kind"), edges


def qubo(sized: DataFrame, base=erdos_renyi, scale: float = 1.0, seed: int = 0, **how) -> tuple[DataFrame, DataFrame]:
    """Nodes with a bias and edges with a coupling, uniform about 0."""
    bias = (2 * draw(seed, "graph_id", "node_id", F.lit("bias")) - 1) * scale
    return nodes(sized).withColumn("bias", bias), base(sized, seed=seed, **how).withColumn("weight", 2 * draw(seed, "graph_id", "src", "dst", F.lit("coupling")) - 1)


def qubo_of_matrix(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Biases and couplings of (graph_id, i, j, q) cells: the diagonal, and both triangles added; zero couplings left out."""
    size = cells.select("graph_id", F.explode(F.array("i", "j")).alias("node_id")).distinct()
    diagonal = cells.where("i = j").groupBy("graph_id", F.col("i").alias("node_id")).agg(F.sum("q").alias("bias"))
    bias = size.join(diagonal, ["graph_id", "node_id"], "left").withColumn("bias", F.coalesce("bias", F.lit(0.0)))
    pair = cells.where("i != j").groupBy("graph_id", F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).agg(F.sum("q").alias("weight"))
    return bias, pair.where("weight != 0")


def cubic_lattice(spark: SparkSession, side: int, dims: int = 3, graphs: int = 1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A periodic lattice with integer coordinates and normal weights; parallel edges of side 2 are one."""
    total = side**dims
    at = spark.range(graphs * total).select(F.floor(F.col("id") / total).alias("graph_id"), (F.col("id") % total).alias("node_id"))
    axis = lambda k: F.floor(F.col("node_id") / side**k) % side
    own = at.withColumn("position", F.array(*[axis(k) for k in range(dims)]))
    step = F.explode(F.array(*[F.col("node_id") + ((axis(k) + 1) % side - axis(k)) * side**k for k in range(dims)]))
    edges = _simple(at.select("graph_id", F.col("node_id").alias("u"), step.alias("v")))
    u, v = (F.greatest(draw(seed, "graph_id", "src", "dst", F.lit(c)), F.lit(1e-12)) for c in "uv")
    return own, edges.withColumn("weight", F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v))


#: Generators by name, for configurations.
NAMES = {"er": erdos_renyi, "erdos_renyi": erdos_renyi, "ba": preferential, "barabasi_albert": preferential, "plc": powerlaw_cluster, "powerlaw_cluster": powerlaw_cluster, "tree": tree, "powerlaw_tree": powerlaw_tree}
