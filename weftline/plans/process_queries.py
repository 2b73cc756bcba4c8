"""Registered queries of processes on graphs and of series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import dynamics as D
from weftline.operators import local as L
from weftline.plans.graph_queries import _brand, _r, query
from weftline.plans.more_queries import _incidence
from weftline.plans.views import brand_nodes, table


def _rounds(first: str, step: str, n: int) -> str:
    """``step`` over the rows before it, n times, as a chain of materialised tables."""
    return f", y0 as materialized ({first})" + "".join(f", y{k + 1} as materialized ({step.format(f'y{k}')})" for k in range(n))


_NEAR = "select d.g, d.v, d.k, {0}.x x, coalesce(sum(z.x), 0) f from d join {{0}} {0} on {0}.g = d.g and {0}.v = d.v left join b on b.g = d.g and b.u = d.v left join {{0}} z on z.g = b.g and z.v = b.v group by 1, 2, 3, 4".format("o")


@query(_rounds("select g, v, 0.5::double x from n", f"select g, v, 0.3::double * f / (1 + 0.3::double * f) x from ({_NEAR})", 20) + " select g graph_id, count(*) n, round(sum(x), 6) risk from y20 group by 1")
def sis_risk(spark, sf_dir):
    return L.per_graph(*_brand(spark, sf_dir), D.sis_risk, "graph_id string, n long, risk double").withColumn("risk", _r("risk"))


@query(_rounds("select g, v, 0::double x from n", f"select g, v, tanh(1.5::double * f / greatest(k, 1) + 0.2::double) x from ({_NEAR})", 20) + " select g graph_id, v node_id, round(x, 6) x from y20")
def coupled_map(spark, sf_dir):
    of = L.per_graph(*_brand(spark, sf_dir), D.coupled_map, "graph_id string, step long, node_id long, x double")
    return of.where("step = 19").select("graph_id", "node_id", _r("x").alias("x"))


@query(_rounds("select g, v, (v % 5 + 1) / 10::double x from n", f"select g, v, least(greatest(x + 0.05::double * x * (1 - x + 0.5::double * f / greatest(k, 1)), 0), 10) x from ({_NEAR})", 20) + " select g graph_id, v node_id, round(x, 6) x from y20")
def glv_population(spark, sf_dir):
    of = L.per_graph(*_brand(spark, sf_dir), D.glv, "graph_id string, step long, node_id long, x double")
    return of.where("step = 19").select("graph_id", "node_id", _r("x").alias("x"))


@query(
    "with d as (select user_id, ts::date d, avg(value) x from events group by 1, 2), r as (select *, row_number() over (partition by user_id order by d desc) b from d), w as (select * from r where b <= 10), "
    "a as (select user_id, list_sort(list(x)) v, abs(avg(x) filter (b <= 5) - avg(x) filter (b > 5)) g from w group by 1) "
    "select user_id, round(v[(len(v) + 1) // 2], 6) steady, round(g, 6) drift, g < 1e-3 or g / (abs(v[(len(v) + 1) // 2]) + 1e-6) < 0.05 settled from a",
    view=False,
)
def steady_values(spark, sf_dir):
    """Daily means of every user: the steady value of the last ten days and whether it has settled."""
    day = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("x"))
    return D.steady_state(day, ["user_id"], "day", "x").select("user_id", _r("steady").alias("steady"), _r("drift").alias("drift"), "settled")


@query(
    "with t as (select n_regionkey g, o_custkey c, l_partkey p, l_suppkey s from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where l_partkey % 3 <> 0), "
    "a as (select g, p, count(distinct c) filter (c % 5 <> 0) c, count(distinct s) s from t group by 1, 2) select g graph_id, sum(c * s)::bigint chains from a group by 1",
    view=False,
)
def combat_chains(spark, sf_dir):
    """Customers sense, parts decide, suppliers act, by region; a third of parts and a fifth of customers are gone."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").where("l_partkey % 3 != 0").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    ends = F.explode(F.array(F.struct(F.lit("S").alias("role"), F.col("o_custkey").alias("other")), F.struct(F.lit("I").alias("role"), F.col("l_suppkey").alias("other"))))
    edges = rows.select(F.col("n_regionkey").alias("graph_id"), F.col("l_partkey").alias("decision"), ends.alias("e")).select("graph_id", "decision", "e.*")
    return D.combat_chains(edges.where("role = 'I' or other % 5 != 0").distinct())


def layered_edges(spark, sf_dir) -> DataFrame:
    """Brand edges in two layers, shipped in odd and in even orders; a pair may be in both. ``weight`` is the layer."""
    bought = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    of = bought.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.col("p_brand").alias("graph_id")), "p")
    pairs = of.withColumnRenamed("p", "src").join(of.withColumnRenamed("p", "dst"), ["o", "graph_id"]).where("src < dst")
    return pairs.select("graph_id", "src", "dst", (F.col("o") % 2).alias("weight")).distinct()


@query()
def mutual_component(spark, sf_dir):
    return L.per_graph(brand_nodes(spark, sf_dir), layered_edges(spark, sf_dir), D.mutual_component, "graph_id string, n long, largest long")


@query()
def cascade_survivors(spark, sf_dir):
    of = _incidence(spark, sf_dir).select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.col("o").alias("weight"))
    return L.per_graph(brand_nodes(spark, sf_dir), of, D.cascade, "graph_id string, node_id long, survives boolean")


@query()
def expected_influence(spark, sf_dir):
    return L.per_graph(*_brand(spark, sf_dir), D.influence, "graph_id string, n long, seeds long, reached double")
