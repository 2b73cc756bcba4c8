"""Random graphs as tables; every draw is a hash of (seed, graph, ends), so a rerun gives the same graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.connect import IN_TASK, _resolve
from weftline.scratch import Rounds

#: Edges of a range of pairs, drawn in one go.
RANGE = 1 << 16


def draw(seed: int, *keys: str | Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def sizes(spark: SparkSession, graphs: int, low: int, high: int, seed: int = 0) -> DataFrame:
    return spark.range(graphs).select(F.col("id").alias("graph_id"), (low + F.floor(draw(seed, "id") * (high - low + 1))).cast("long").alias("n"))


def nodes(sized: DataFrame) -> DataFrame:
    return sized.select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("node_id"))


def _pairs(sized: DataFrame) -> DataFrame:
    """All src < dst, made row by row, without a join."""
    src = sized.select("graph_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 2)).alias("src")).where("n > 1")
    return src.select("graph_id", "n", "src", F.explode(F.sequence(F.col("src") + 1, F.col("n") - 1)).alias("dst"))


def complete(sized: DataFrame) -> DataFrame:
    return _pairs(sized).select("graph_id", "src", "dst", F.lit(1.0).alias("weight"))


def _skips(spaces: DataFrame, seed: int) -> DataFrame:
    """graph_id, src, dst: each pair of a space with probability p, one row an edge, never a row a pair.

    ``spaces``: graph_id, part, height, width, triangle, src0, dst0, p; pairs of src0 + i and dst0 + j, of i < j alone in a triangle, where width is height.
    Pairs are numbered, and the numbers cut into ranges of about ``RANGE`` edges; in a range, geometric gaps lead from one edge to the next. A range's draws depend on
    seed, graph, part and range alone, so the graph does not depend on partitions. Numbers stay below 2^63: up to 4e9 nodes.
    """
    total = F.expr("case when triangle then height * (height - 1) div 2 else height * width end")
    ranged = spaces.withColumn("total", total).where("total > 0 and p > 0").withColumn("step", F.greatest(F.lit(1), F.least("total", F.ceil(F.try_divide(F.lit(float(RANGE)), "p")))).cast("long"))
    ranges = ranged.withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(total - 1) div step"))))
    ranges = ranges.withColumn("key", F.xxhash64("graph_id").bitwiseAND(F.lit((1 << 62) - 1)))
    names = ["graph_id", "src", "dst"]
    schema = T.StructType([T.StructField("graph_id", spaces.schema["graph_id"].dataType), *[T.StructField(c, T.LongType()) for c in names[1:]]])

    def run(batches):
        for batch in batches:
            cells = batch.select(["key", "part", "range", "step", "total", "height", "width", "triangle", "src0", "dst0", "p"]).to_pylist()
            for row, c in enumerate(cells):
                rng = np.random.default_rng([seed, c["key"], c["part"], c["range"]])
                at, end = c["range"] * c["step"], min((c["range"] + 1) * c["step"], c["total"])
                while at < end:
                    some = int(min((end - at) * c["p"] * 1.1 + 100, RANGE))
                    k = at - 1 + np.cumsum(rng.geometric(min(c["p"], 1.0), some))
                    at, k = int(k[-1]) + 1, k[k < end]
                    if len(k):
                        i, j = _corner(k, c["height"]) if c["triangle"] else (k // c["width"], k % c["width"])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(k), row))), pa.array(i + c["src0"]), pa.array(j + c["dst0"])], names)

    dealt = ranges.select("graph_id", "key", "part", "range", "step", "total", "height", "width", "triangle", "src0", "dst0", F.col("p").cast("double").alias("p"))
    return dealt.repartition("graph_id", "part", "range").mapInArrow(run, schema)


def _corner(k: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th pair i < j below n, row by row; a guess by square root, put right in integers."""
    first = lambda i: i * (2 * n - i - 1) // 2
    b = 2.0 * n - 1
    i = np.clip(((b - np.sqrt(np.maximum(b * b - 8.0 * k, 0))) / 2).astype(np.int64), 0, n - 2)
    while True:
        wrong = (first(i + 1) <= k).astype(np.int64) - (first(i) > k)
        if not wrong.any():
            return i, k - first(i) + i + 1
        i += wrong


def _space(height, width, triangle, src0, dst0, p, part) -> list[Column]:
    long = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    return [long(height).alias("height"), long(width).alias("width"), (triangle if isinstance(triangle, Column) else F.lit(triangle)).alias("triangle"), long(src0).alias("src0"), long(dst0).alias("dst0"), (p if isinstance(p, Column) else F.lit(float(p))).alias("p"), long(part).alias("part")]


def erdos_renyi(sized: DataFrame, p: float = 0.15, seed: int = 0) -> DataFrame:
    """Each pair with probability ``p``."""
    n = F.col("n")
    return _skips(sized.select("graph_id", *_space(n, n, True, 0, 0, p, 0)), seed).withColumn("weight", F.lit(1.0))


def stochastic_blocks(sized: DataFrame, blocks: int = 2, p_in: float = 0.3, p_out: float = 0.02, seed: int = 0) -> DataFrame:
    """Blocks of consecutive nodes, sizes equal but for one; pairs with probability ``p_in`` within and ``p_out`` between."""
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks * blocks - 1)), lambda k: F.struct(F.floor(k / blocks).alias("a"), (k % blocks).alias("b"), k.alias("part")))).alias("x")
    of = sized.select("graph_id", "n", pair).select("graph_id", "n", "x.*").where("a <= b")
    first = lambda c: F.ceil(F.col(c) * F.col("n") / blocks)
    size = lambda c: F.ceil((F.col(c) + 1) * F.col("n") / blocks) - first(c)
    same = F.col("a") == F.col("b")
    return _skips(of.select("graph_id", *_space(size("a"), size("b"), same, first("a"), first("b"), F.when(same, float(p_in)).otherwise(float(p_out)), F.col("part"))), seed).withColumn("weight", F.lit(1.0))


def geometric(sized: DataFrame, radius: float = 0.2, seed: int = 0) -> DataFrame:
    """Points of the unit square joined within ``radius``; cells of that side make it an equi-join."""
    at = nodes(sized).select("graph_id", "node_id", draw(seed, "graph_id", "node_id", F.lit("x")).alias("x"), draw(seed, "graph_id", "node_id", F.lit("y")).alias("y"))
    cell = at.withColumn("cx", F.floor(F.col("x") / radius)).withColumn("cy", F.floor(F.col("y") / radius))
    around = cell.select("graph_id", F.col("node_id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.struct((F.col("cx") + k % 3 - 1).alias("cx"), (F.col("cy") + F.floor(k / 3) - 1).alias("cy")))).alias("c")).select("*", "c.cx", "c.cy")
    near = cell.join(around, ["graph_id", "cx", "cy"]).where(F.col("node_id") < F.col("dst")).where((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 <= radius**2)
    return near.select("graph_id", F.col("node_id").alias("src"), "dst", F.lit(1.0).alias("weight"))


def lattice(spark: SparkSession, side: int, graphs: int = 1) -> DataFrame:
    """A periodic square grid."""
    cells = spark.range(graphs * side * side).select(F.floor(F.col("id") / (side * side)).alias("graph_id"), (F.col("id") % (side * side)).alias("k"))
    x, y = F.col("k") % side, F.floor(F.col("k") / side)
    ends = cells.select("graph_id", "k", F.explode(F.array(y * side + (x + 1) % side, (y + 1) % side * side + x)).alias("to"))
    return ends.select("graph_id", F.least("k", "to").alias("src"), F.greatest("k", "to").alias("dst"), F.lit(1.0).alias("weight")).where("src < dst").distinct()


def _simple(ends: DataFrame) -> DataFrame:
    pairs = ends.select("graph_id", F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).where("src < dst")
    return pairs.distinct().withColumn("weight", F.lit(1.0))


def small_world(sized: DataFrame, k: int = 4, p: float = 0.1, seed: int = 0) -> DataFrame:
    """A ring of ``k`` nearest neighbours whose far ends move with probability ``p``; as many edges as the ring has.

    A moved end that makes a loop or meets another edge draws again, in rounds, until none does. Rings that join all pairs are left as they are.
    """
    rounds = Rounds(sized.sparkSession, "small_world")
    ring = sized.select("graph_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("u")).select("*", F.explode(F.sequence(F.lit(1), F.lit(max(k // 2, 1)))).alias("j"))
    ring = ring.where((2 * F.col("j") < F.col("n")) | ((2 * F.col("j") == F.col("n")) & (F.col("u") < F.col("j"))))
    moves = (F.col("n") - 1 > max(k // 2, 1) * 2) & (draw(seed, "graph_id", "u", "j", F.lit("move")) < p)
    slots = rounds.put(ring.select("*", moves.alias("moves"), F.lit(0).cast("long").alias("tries")))
    for _ in range(1000):
        far = F.floor(draw(seed, "graph_id", "u", "j", "tries", F.lit("to")) * (F.col("n") - 1)) + 1
        at = slots.withColumn("v", ((F.col("u") + F.when(F.col("moves"), far).otherwise(F.col("j"))) % F.col("n")).cast("long"))
        again = F.row_number().over(Window.partitionBy("graph_id", F.least("u", "v"), F.greatest("u", "v")).orderBy("moves", "u", "j")) > 1
        new, repeats = rounds.counted(at.withColumn("again", again).withColumn("tries", F.col("tries") + F.col("again").cast("long")), F.col("again"))
        rounds.drop(slots)
        if not repeats:
            return _simple(new)
        slots = new.drop("v", "again")
    raise RuntimeError("repeated edges are left after 1000 rounds")


def tree(sized: DataFrame, seed: int = 0) -> DataFrame:
    """A tree, every labelled tree as likely as any other.

    Joyal's bijection: of a random function on the nodes, the nodes on its cycles, in order, lead a path through their images; all others hang on theirs. The nodes on cycles are the image of
    the function applied at least n times, by doubling. They are about 1.25 times the root of n, and are put in order in one task a graph.
    """
    rounds = Rounds(sized.sparkSession, "tree")
    image = F.floor(draw(seed, "graph_id", "node_id") * F.col("n")).cast("long")
    f = rounds.put(nodes(sized).join(sized.select("graph_id", "n"), "graph_id").select("graph_id", "node_id", image.alias("to")))
    most, far, times = sized.agg(F.max("n")).first()[0] or 0, f, 1
    while times < most:
        new = rounds.put(far.join(far.select("graph_id", F.col("node_id").alias("to"), F.col("to").alias("next")).hint("merge"), ["graph_id", "to"]).select("graph_id", "node_id", F.col("next").alias("to")))
        if times > 1:
            rounds.drop(far)
        far, times = new, 2 * times
    cyclic = rounds.put(far.select("graph_id", F.col("to").alias("node_id")).distinct())
    order = Window.partitionBy("graph_id").orderBy("node_id")
    path = f.join(cyclic, ["graph_id", "node_id"], "left_semi").select("graph_id", F.col("to").alias("u"), F.lead("to").over(order).alias("v")).where("v is not null")
    hung = f.join(cyclic, ["graph_id", "node_id"], "left_anti").select("graph_id", F.col("node_id").alias("u"), F.col("to").alias("v"))
    return _simple(path.unionByName(hung))


def _shuffled(at: np.ndarray, total: int, key: int) -> np.ndarray:
    """A bijection of 0 to total - 1 by key: four rounds of a Feistel network over the next power of four, again for what falls outside."""
    half = np.uint64(max(1, (int(total - 1).bit_length() + 1) // 2))
    mask, out = np.uint64((1 << int(half)) - 1), at.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for k in range(4):
            mixed = (right + np.uint64((key + k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= total]
    return out.astype(np.int64)


def regular(sized: DataFrame, degree: int = 3, seed: int = 0) -> DataFrame:
    """A random graph in which every node has ``degree`` neighbours, n - 1 at most; n is one more where n times degree is odd.

    The ends of all nodes are dealt into pairs by a bijection, edge by edge. Loops and repeats are mended in rounds: each draws another edge by hash, and the two swap ends;
    an edge that is drawn twice goes to one of them. Degrees of more than half the nodes are made as the complement of the rest.
    """
    rounds = Rounds(sized.sparkSession, "regular")
    n = F.col("n") + (F.col("n") * F.least(F.lit(degree), F.col("n") - 1)) % 2
    of = sized.select("graph_id", n.alias("n")).withColumn("d", F.least(F.lit(degree).cast("long"), F.col("n") - 1))
    of = rounds.put(of.withColumn("dense", F.col("d") * 2 > F.col("n") - 1).withColumn("k", F.when(F.col("dense"), F.col("n") - 1 - F.col("d")).otherwise(F.col("d"))).withColumn("m", F.expr("n * k div 2")))
    kind = sized.schema["graph_id"].dataType
    schema = T.StructType([T.StructField("graph_id", kind), *[T.StructField(c, T.LongType()) for c in ("e", "u", "v", "m")]])

    def deal(batches):
        for batch in batches:
            for row, c in enumerate(batch.select(["key", "n", "k", "m", "part"]).to_pylist()):
                e = np.arange(c["part"] * RANGE, min((c["part"] + 1) * RANGE, c["m"]))
                ends = [_shuffled(2 * e + side, c["n"] * c["k"], c["key"] ^ seed) // c["k"] for side in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(e), row))), *map(pa.array, (e, *ends, np.full(len(e), c["m"])))], schema.names)

    parts = of.where("m > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {RANGE}")))).withColumn("key", F.xxhash64("graph_id", F.lit("ends")).bitwiseAND(F.lit((1 << 62) - 1)))
    edges = rounds.put(parts.select("graph_id", "key", "n", "k", "m", "part").repartition("graph_id", "part").mapInArrow(deal, schema))
    for turn in range(1000):
        same = Window.partitionBy("graph_id", F.least("u", "v"), F.greatest("u", "v")).orderBy("e")
        bad, count = rounds.counted(edges.withColumn("nth", F.row_number().over(same)).where("u = v or nth > 1").drop("nth"), F.lit(1))
        if not count:
            break
        drawn = bad.withColumn("other", F.floor(draw(seed, "graph_id", "e", F.lit(f"swap{turn}")) * F.col("m")).cast("long"))
        asked = drawn.groupBy("graph_id", F.col("other")).agg(F.min("e").alias("e")).join(bad.select("graph_id", F.col("e").alias("other")), ["graph_id", "other"], "left_anti")
        mine = bad.drop("m").join(asked, ["graph_id", "e"])
        theirs = edges.select("graph_id", F.col("e").alias("other"), F.col("u").alias("x"), F.col("v").alias("y"))
        both = mine.join(theirs, ["graph_id", "other"])
        new = both.select("graph_id", F.explode(F.array(F.struct("e", F.col("u").alias("nu"), F.col("y").alias("nv")), F.struct(F.col("other").alias("e"), F.col("x").alias("nu"), F.col("v").alias("nv")))).alias("s")).select("graph_id", "s.*")
        after = rounds.put(edges.join(new, ["graph_id", "e"], "left").select("graph_id", "e", F.coalesce("nu", "u").alias("u"), F.coalesce("nv", "v").alias("v"), "m"))
        rounds.drop(edges, bad)
        edges = after
    else:
        raise RuntimeError("repeated edges are left after 1000 rounds of swaps")
    made = _simple(edges)
    dense = of.where("dense").select("graph_id", "n")
    rest = complete(dense).join(made, ["graph_id", "src", "dst"], "left_anti")
    return made.join(of.where("not dense").select("graph_id"), "graph_id", "left_semi").unionByName(rest)


def preferential(sized: DataFrame, m: int = 4, seed: int = 0, in_task: int = IN_TASK) -> DataFrame:
    """Each node from the m-th on joins ``m`` different earlier ones, drawn by degree; node m joins all before it. m is from 1 to n - 1.

    An edge's end copies an end of an earlier edge, drawn by hash among all ends so far: the newer end is a known node, the older one a copy itself, followed by pointer jumping. Ends that repeat within a
    node draw again, with what copied them, until none does. All edges of a graph are made side by side: of at most ``in_task`` edges in one task a graph, of more in joins, with equal results.
    """
    rounds = Rounds(sized.sparkSession, "preferential")
    of = sized.where("n > 1").select("graph_id", "n", F.greatest(F.lit(1), F.least(F.lit(m).cast("long"), F.col("n") - 1)).alias("m"))
    small = (F.col("n") - F.col("m")) * F.col("m") <= in_task
    grown = _grown_in_tasks(_slots(of.where(small)), seed, rounds)
    large = of.where(~small)
    if not large.isEmpty():
        grown = grown.unionByName(_grown_in_joins(_slots(large), seed, rounds))
    return grown.select("graph_id", F.col("to").alias("src"), F.col("node_id").alias("dst"), F.lit(1.0).alias("weight"))


def _slots(of: DataFrame) -> DataFrame:
    """Every edge to be made: its newer node, its place among the node's and among all."""
    each = of.withColumn("node_id", F.explode(F.expr("sequence(m, n - 1)"))).withColumn("j", F.explode(F.expr("sequence(cast(0 as bigint), m - 1)")))
    return each.select("graph_id", "m", "node_id", "j", ((F.col("node_id") - F.col("m")) * F.col("m") + F.col("j")).alias("e"), F.lit(0).cast("long").alias("tries"))


def _grown_in_tasks(slots: DataFrame, seed: int, rounds: Rounds) -> DataFrame:
    """graph_id, node_id, to. Tasks get each edge's next draws, more for early nodes, which repeat more; a graph that runs out of them comes back with its count of tries and gets the next ones."""
    ahead = F.sequence(F.lit(0), F.when(F.col("e") < 4096, 23).otherwise(1))
    draws = F.transform(ahead, lambda k: draw(seed, "graph_id", "e", F.col("tries") + k.cast("long"), F.lit("copy")))
    longs = ["m", "node_id", "j", "e", "tries", "to"]
    schema = T.StructType([slots.schema["graph_id"], *[T.StructField(c, T.LongType()) for c in longs], T.StructField("short", T.BooleanType())])

    def grow(key, table):
        m, v, j, e, tries = (table[c].to_numpy() for c in longs[:-1])
        order = np.argsort(e)
        lists = pa.concat_arrays(table["draws"].chunks)
        begin = (lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py())[order]
        to, used = _grown(int(m[0]), v[order], j[order], lists.flatten().to_numpy(), begin, pa.compute.list_value_length(lists).to_numpy()[order])
        columns = [x[order] for x in (m, v, j, e)] + [tries[order] + used, np.full(len(e), -1) if to is None else to]
        return pa.table([pa.array([key[0].as_py()] * len(e), table["graph_id"].type), *map(pa.array, columns), pa.array(np.full(len(e), to is None))], ["graph_id", *longs, "short"])

    done = None
    for _ in range(1000):
        made, short = rounds.counted(slots.withColumn("draws", draws).groupBy("graph_id").applyInArrow(grow, schema), F.col("short"))
        whole = made.where("not short").select("graph_id", "node_id", "to")
        done = whole if done is None else done.unionByName(whole)
        if not short:
            return done
        slots = made.where("short").drop("to", "short")
    raise RuntimeError("repeated ends are left after 1000 rounds")


def _grown(m: int, v: np.ndarray, j: np.ndarray, draws: np.ndarray, begin: np.ndarray, many: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """The older end of every edge of one graph, in order, or None if its draws run out, and how often each was drawn again."""
    used, first = np.zeros(len(v), np.int64), v == m
    while (used < many).all():
        end = np.floor(draws[begin + used] * 2 * m * (v - m)).astype(np.int64)
        up = np.where(first | (end % 2 == 0), np.arange(len(v)), end // 2)
        own = np.where(first, j, m + end // 2 // m)
        while True:
            far = up[up]
            if (far == up).all():
                break
            up = far
        to = own[up]
        side = to.reshape(-1, m)
        sort = np.argsort(side, axis=1, kind="stable")
        held = np.take_along_axis(side, sort, 1)
        again = np.zeros(side.shape, bool)
        np.put_along_axis(again, sort[:, 1:], held[:, 1:] == held[:, :-1], 1)
        if not again.any():
            return to, used
        used += again.ravel()
    return None, used


def _grown_in_joins(slots: DataFrame, seed: int, rounds: Rounds) -> DataFrame:
    """graph_id, node_id, to."""
    slots = rounds.put(slots)
    for _ in range(1000):
        end = F.floor(draw(seed, "graph_id", "e", "tries", F.lit("copy")) * 2 * F.col("m") * (F.col("node_id") - F.col("m"))).cast("long")
        drawn = slots.withColumn("end", F.when(F.col("node_id") > F.col("m"), end)).withColumn("up", F.expr("end div 2"))
        own = F.when(F.col("end").isNull(), F.col("j")).when(F.col("end") % 2 == 0, F.expr("m + up div m"))
        at = rounds.put(drawn.select("graph_id", "node_id", "j", "e", "tries", "m", "up", own.cast("long").alias("to")))
        top = _resolve(at.where("to is null").select("graph_id", F.col("e").alias("u"), "up"), ["graph_id"], rounds)
        known = at.where("to is not null").select("graph_id", F.col("e").alias("up"), F.col("to").alias("far"))
        full = at.drop("up").join(top.withColumnRenamed("u", "e").join(known, ["graph_id", "up"]).drop("up"), ["graph_id", "e"], "left")
        full = full.withColumn("to", F.coalesce("to", "far"))
        again = F.row_number().over(Window.partitionBy("graph_id", "node_id", "to").orderBy("j")) > 1
        new, repeats = rounds.counted(full.withColumn("again", again).select("graph_id", "m", "node_id", "j", "e", (F.col("tries") + F.col("again").cast("long")).alias("tries"), "to", "again"), F.col("again"))
        rounds.drop(at, top, slots)
        if not repeats:
            return new.select("graph_id", "node_id", "to")
        slots = new.drop("to", "again")
    raise RuntimeError("repeated ends are left after 1000 rounds")


def hypergraph(sized: DataFrame, hyperedges: int, size: int, seed: int = 0) -> DataFrame:
    """graph_id, hyperedge_id, node_id: members drawn with replacement, repeats merged."""
    each = sized.select("graph_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hyperedges - 1).cast("long"))).alias("hyperedge_id"))
    member = each.select("*", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("j"))
    return member.select("graph_id", "hyperedge_id", F.floor(draw(seed, "graph_id", "hyperedge_id", "j") * F.col("n")).alias("node_id")).distinct()


def weights(edges: DataFrame, kind: str = "unit", seed: int = 0, **p: float) -> DataFrame:
    """``edges`` with weights of a distribution by name."""
    u, v = draw(seed, "graph_id", "src", "dst", F.lit("u")), draw(seed, "graph_id", "src", "dst", F.lit("v"))
    normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)
    made = {
        "unit": F.lit(1.0),
        "normal": normal * p.get("std", 1.0) + p.get("mean", 0.0),
        "uniform": p.get("low", 0.0) + u * (p.get("high", 1.0) - p.get("low", 0.0)),
        "negative_uniform": -u,
        "bimodal": F.when(u < 0.5, -1.0).otherwise(1.0),
        "lognormal": F.exp(normal),
        "exponential": -F.log(1 - u) / p.get("rate", 1.0),
    }
    if kind not in made:
        raise ValueError(f"no weights of kind {kind}: {', '.join(made)}")
    return edges.withColumn("weight", made[kind])
