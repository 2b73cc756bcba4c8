"""Registered attacks on brand graphs (removal orders, robustness, re-insertion, search), heuristics and exact solvers."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import attacks as A
from weftline.operators import local as L
from weftline.operators import solvers as V
from weftline.plans.graph_queries import QUERIES, _brand, _pair_view, query
from weftline.plans.views import table

_FOUR = "n long, removed long, nd double, cn double, nd_cost double, cn_cost double"


def _put(name: str, kernel, schema: str, doc: str) -> None:
    def run(spark, sf_dir):
        return L.per_graph(*_brand(spark, sf_dir), kernel, f"graph_id string, {schema}")

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run


def _put_local(kind: str) -> None:
    def run(spark, sf_dir):
        return A.attack_in_parts(*_brand(spark, sf_dir), kind)

    run.__name__, run.__doc__ = f"attack_{kind}", f"Robustness of the attack by {kind}, a graph's pieces in tasks of their own."
    QUERIES[run.__name__] = run


for _kind in A.SCORES:
    if _kind in A.LOCAL:
        _put_local(_kind)
    else:
        _put(f"attack_{_kind}", A.attack(_kind), _FOUR, f"Robustness of the attack by {_kind}.")
for _strategy in ("count", "rank", "multiple"):
    _put(f"reinsert_{_strategy}", A.reinserted(_strategy), "n long, removed long, before double, after double", f"Degree attack re-inserted by {_strategy}.")
_put("reinsert_cost", A.reinserted("rank", True), "n long, removed long, before double, after double", "Re-insertion by rank times cost.")
_put("search_adaptive", A.searched(), "n long, plain double, found double", "Removal order searched by adaptively drawn moves.")
_put("search_learned", A.searched(True), "n long, plain double, found double", "Removal order searched by moves of learned value.")
_put("edge_attack_pairs", A.edge_attack(True), "n long, m long, connectivity double", "Edge removal, connected pairs.")
_put("edge_attack_squares", A.edge_attack(False), "n long, m long, connectivity double", "Edge removal, squared component edges.")

_SOLVERS = {
    "annealed_cut": "n long, cut double",
    "annealed_set": "n long, nodes long, total double",
    "weighted_set": "step long, node_id long",
    "dominating_set": "step long, node_id long",
    "clique": "step long, node_id long",
    "edge_cover_nodes": "node_id long, first boolean",
    "descended_form": "n long, energy double, flips long",
    "climbed_modularity": "n long, q double",
    "laplacian_coordinates": "node_id long, x array<double>",
}
for _name, _schema in _SOLVERS.items():
    _put(_name, getattr(V, _name), _schema, getattr(V, _name).__doc__)
_put("spectral_modularity", partial(V.spectral_modularity, most=None), "n long, q double", "Two communities by the sign of the modularity matrix's leading eigenvector, of graphs of any size.")


@query()
def exact_sets(spark, sf_dir):
    n, e = _pair_view(spark, sf_dir)
    return L.per_graph(n, e, V.exact_sets, "graph_id long, n long, independent long, cover long, heaviest double")


def _supplied(spark, sf_dir):
    """Suppliers as sets of the parts they ship, by the supplier's nation."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").select("l_suppkey", "l_partkey").distinct().join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("s_nationkey").alias("graph_id"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit(1).alias("weight"))


@query()
def set_cover(spark, sf_dir):
    return V.set_covers(_supplied(spark, sf_dir)).withColumn("graph_id", F.col("graph_id").cast("long"))


@query(
    "with recursive c as (select user_id g, event_type t, ts, event_id from events), ty as (select t, row_number() over (order by t) - 1 i from (select distinct event_type t from events)), "
    "a as (select g, ty.i, lead(ty.i) over (partition by g order by ts, event_id) z from c join ty using (t)), "
    "e as (select g, least(i, z) u, greatest(i, z) v, count(*) w from a where z is not null and z <> i group by 1, 2, 3), "
    "k as (select unnest(range(0, 1 << (select count(*)::int from ty))) m), "
    "s as (select g, m, sum(w * ((m >> u) & 1) * ((m >> v) & 1)) q from e, k group by 1, 2), "
    "p as (select g, count(distinct i) n, bit_or(1 << i::int) has from a group by 1), "
    "b as (select m, sum(((m >> i) & 1) * (i % 7 - 3)) l from k, ty group by 1) "
    "select p.g graph_id, n, least(min(l + coalesce(q, 0)), 0)::double energy from p join k on (k.m & ~has) = 0 join b on b.m = k.m left join s on s.g = p.g and s.m = k.m group by 1, 2",
    view=False,
)
def least_form(spark, sf_dir):
    """Every user's graph of consecutive event types: the least quadratic form by trying all assignments."""
    ev = table(spark, sf_dir, "events")
    code = ev.select("event_type").distinct().select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long").alias("node_id"))
    of = ev.join(F.broadcast(code), "event_type").withColumn("next", F.lead("node_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    e = of.where("next is not null and next != node_id").groupBy(F.col("user_id").alias("graph_id"), F.least("node_id", "next").alias("src"), F.greatest("node_id", "next").alias("dst")).agg(F.count("*").alias("weight"))
    return L.per_graph(of.select(F.col("user_id").alias("graph_id"), "node_id").distinct(), e, V.least_form, "graph_id long, n long, energy double")
