"""More registered graph queries: hypergraph aggregation, pair views, objective values and per-graph heuristics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import local as L
from weftline.operators import search as S
from weftline.plans.graph_queries import QUERIES, _brand, _r, query
from weftline.plans.views import both, brand_edges, brand_nodes, table


def _incidence(spark, sf_dir) -> DataFrame:
    """graph_id, o, node_id: parts of one brand in one order, two or more."""
    bought = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("node_id")).distinct()
    of = bought.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_brand").alias("graph_id")), "node_id")
    size = of.groupBy("graph_id", "o").agg(F.count("*").alias("k")).where("k > 1")
    return of.join(size.select("graph_id", "o"), ["graph_id", "o"], "left_semi")


@query(" select distinct g graph_id, u src, v dst from e")
def clique_expansion(spark, sf_dir):
    return brand_edges(spark, sf_dir).select("graph_id", "src", "dst")


@query(", big as (select o, g from op group by 1, 2 having count(*) > 1), h as (select op.o, op.g, avg(p_size) m from op join big using (o, g) join n on n.v = op.p group by 1, 2) select op.g graph_id, op.p node_id, round(avg(h.m), 6) x from op join h on h.o = op.o and h.g = op.g group by 1, 2")
def hyperedge_two_stage_mean(spark, sf_dir):
    """Node sizes averaged over each hyperedge, then over a node's hyperedges."""
    of = _incidence(spark, sf_dir)
    x = brand_nodes(spark, sf_dir).select("graph_id", "node_id", F.col("size").alias("x"))
    mean = of.join(x, ["graph_id", "node_id"]).groupBy("graph_id", "o").agg(F.avg("x").alias("m"))
    return of.join(mean, ["graph_id", "o"]).groupBy("graph_id", "node_id").agg(_r(F.avg("m")).alias("x"))


@query(" select distinct x.g graph_id, x.v src, y.v dst from b x join b y on x.g = y.g and x.u = y.u and x.v < y.v")
def common_neighbour_pairs(spark, sf_dir):
    """Pairs of nodes with a neighbour in common."""
    b = both(brand_edges(spark, sf_dir)).select("graph_id", "u", "v")
    return b.withColumnRenamed("v", "src").join(b.withColumnRenamed("v", "dst"), ["graph_id", "u"]).where("src < dst").select("graph_id", "src", "dst").distinct()


@query(", f as (select g, min(u) u from e group by 1), f2 as (select e.g, f.u, min(e.v) v from e join f on f.g = e.g and f.u = e.u group by 1, 2), s as (select g, u x from f2 union all select g, v from f2) select b.g graph_id, b.v node_id from b join s on s.g = b.g and s.x = b.u where not exists (select 1 from s t where t.g = b.g and t.x = b.v) group by 1, 2 having count(*) = 2")
def clique_candidates(spark, sf_dir):
    """Nodes next to both ends of each graph's first edge."""
    e = brand_edges(spark, sf_dir)
    first = e.groupBy("graph_id").agg(F.min(F.struct("src", "dst")).alias("e"))
    ends = first.select("graph_id", F.explode(F.array("e.src", "e.dst")).alias("u"))
    found = both(e).join(ends, ["graph_id", "u"]).groupBy("graph_id", F.col("v").alias("node_id")).agg(F.count("*").alias("k")).where("k = 2")
    return found.select("graph_id", "node_id")


@query(" select n.g graph_id, (sum(case when v % 2 = 0 then p_size - 25 else 0 end) + coalesce(any_value(q), 0))::bigint energy from n left join (select g, sum(w) q from e where u % 2 = 0 and v % 2 = 0 group by 1) x on x.g = n.g group by 1")
def qubo_energy(spark, sf_dir):
    """Linear terms of the chosen nodes (size - 25), and the weights of edges between them."""
    n, e = _brand(spark, sf_dir)
    one = n.groupBy("graph_id").agg(F.sum(F.when(F.col("node_id") % 2 == 0, F.col("size") - 25).otherwise(0)).alias("a"))
    two = e.where("src % 2 = 0 and dst % 2 = 0").groupBy("graph_id").agg(F.sum("weight").alias("q"))
    return one.join(two, "graph_id", "left").select("graph_id", (F.col("a") + F.coalesce("q", F.lit(0))).cast("long").alias("energy"))


@query("with d as (select distinct n_nationkey n, n_regionkey r, p_brand b from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey) select x.n first_nation, y.n second_nation, count(*) shared from d x join d y on x.b = y.b and x.n < y.n where x.r <> y.r group by 1, 2", view=False)
def domain_gaps(spark, sf_dir):
    """Pairs of nations that share domains (brands bought) without being linked (one region)."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    d = rows.select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"), F.col("p_brand").alias("b")).distinct()
    pairs = d.toDF("first_nation", "r1", "b").join(d.toDF("second_nation", "r2", "b"), "b").where("first_nation < second_nation and r1 != r2")
    return pairs.groupBy("first_nation", "second_nation").agg(F.count("*").alias("shared"))


def _kernel(name: str, schema: str) -> None:
    def run(spark, sf_dir):
        return L.per_graph(*_brand(spark, sf_dir), getattr(S, name), f"graph_id string, {schema}")

    run.__name__ = name
    QUERIES[name] = run


_kernel("two_core", "node_id long")
_kernel("independent_set", "step long, node_id long")
_kernel("colouring", "node_id long, colour long")
_kernel("local_cut", "n long, cut double, moves long")
_kernel("pagerank", "node_id long, score double")
_kernel("closeness", "node_id long, score double")
