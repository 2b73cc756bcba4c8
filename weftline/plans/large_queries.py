"""Queries of operators that take one graph of any size: connectivity along removals, mutual components, rounds over frontiers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import connect as C
from weftline.operators import frontier as R
from weftline.operators import graph as G
from weftline.plans.graph_queries import _brand, _r, query
from weftline.plans.views import brand_nodes, table
from weftline.sources import generators as N

#: Connectivity of every prefix of the order by degree: sets of nodes still there are labelled anew for each.
_CURVE = """,
o as (select g, v, row_number() over (partition by g order by k desc, v) - 1 s from d), ks as (select g, s + 1 k from o union select g, 0 from o),
rp(g, k, v, m) as (select o.g, ks.k, v, v from o join ks on ks.g = o.g where s >= ks.k union select rp.g, rp.k, b.v, rp.m from rp join b on b.g = rp.g and b.u = rp.v join o on o.g = b.g and o.v = b.v and o.s >= rp.k),
sz as (select g, k, m, count(*) c from (select g, k, v, max(m) m from rp group by 1, 2, 3) group by 1, 2, 3),
cv as (select ks.g, ks.k, coalesce(max(c), 0) l, coalesce(sum(c * (c - 1) // 2), 0)::bigint p from ks left join sz on sz.g = ks.g and sz.k = ks.k group by 1, 2)"""


def _by_degree(nodes, edges):
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("degree"), "node_id")) - 1
    return G.degree(nodes, edges).select("graph_id", "node_id", place.alias("step"))


@query(_CURVE + " select g graph_id, k removed, l largest, p pairs from cv")
def removal_curve(spark, sf_dir):
    """Largest component and connected pairs after every removal, by degree."""
    n, e = _brand(spark, sf_dir)
    return C.removal_curve(n, e, _by_degree(n, e))


@query(_CURVE + ", c as (select g, count(*) n from n group by 1) select c.g graph_id, n, round(coalesce(sum(l) filter (k >= 1 and k < n), 0) / (n * n)::double, 9) nd, round(coalesce(sum(p) filter (k >= 1 and k < n), 0) / (case when n > 1 then n * (n - 1) / 2 else 1 end * n)::double, 9) cn from c join cv on cv.g = c.g group by c.g, n")
def degree_robustness(spark, sf_dir):
    """Node- and pair-connectivity robustness of the order by degree."""
    n, e = _brand(spark, sf_dir)
    return C.robustness(n, e, _by_degree(n, e)).select("graph_id", "n", _r("nd", 9).alias("nd"), _r("cn", 9).alias("cn"))


@query(_CURVE + """, c as (select g, count(*) n, sum(p_retailprice) w from n group by 1)
  select c.g graph_id, round(sum(l / n::double * p_retailprice / w), 9) nd_cost, round(sum(case when n > 1 then p / (n * (n - 1) / 2) else 0 end * p_retailprice / w), 9) cn_cost
  from c join o on o.g = c.g join cv on cv.g = o.g and cv.k = o.s + 1 join n on n.g = o.g and n.v = o.v group by c.g""")
def cost_robustness(spark, sf_dir):
    """Robustness of the order by degree, weighted by the removed part's share of all prices."""
    n, e = _brand(spark, sf_dir)
    return C.cost_robustness(n, e, _by_degree(n, e), "price").select("graph_id", _r("nd_cost", 9).alias("nd_cost"), _r("cn_cost", 9).alias("cn_cost"))


def _layers(spark, sf_dir):
    """A layer a return flag: parts of one brand that share an order in lines of that flag."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_returnflag").alias("layer")).distinct()
    of = lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("graph_id")), "l_partkey")
    a, b = (of.select("graph_id", "layer", "l_orderkey", F.col("l_partkey").alias(x)) for x in ("src", "dst"))
    return a.join(b, ["graph_id", "layer", "l_orderkey"]).where("src < dst").select("graph_id", "layer", "src", "dst").distinct()


#: Three layers; nodes reach each other within the set of before, in every layer, five times over, which is a fixed point or the SQL's sets still differ.
def _mutual_sql(rounds: int = 5) -> str:
    lay = ", lo as (select distinct l_orderkey o, l_partkey p, l_returnflag f, p_brand g from lineitem join part on p_partkey = l_partkey), le as (select distinct x.g, x.f, x.p u, y.p v from lo x join lo y on x.o = y.o and x.f = y.f and x.g = y.g and x.p <> y.p), fs as (select distinct f from le), s0 as (select g, v, 0::bigint s from n)"
    for k in range(1, rounds + 1):
        lay += f"""
, i{k} as (select le.* from le join s{k - 1} a on a.g = le.g and a.v = le.u join s{k - 1} c on c.g = le.g and c.v = le.v and a.s = c.s),
r{k}(g, f, v, m) as (select g, f, v, v from s{k - 1}, fs union select i.g, i.f, i.v, r.m from r{k} r join i{k} i on i.g = r.g and i.f = r.f and i.u = r.v),
l{k} as (select g, v, string_agg(m::varchar, ',' order by f) t from (select g, f, v, max(m) m from r{k} group by 1, 2, 3) group by 1, 2),
s{k} as (select l.g, l.v, max(l.v) over (partition by l.g, s.s, t) s from l{k} l join s{k - 1} s on s.g = l.g and s.v = l.v)"""
    return lay + f" select g graph_id, v node_id, s label from s{rounds}"


@query(_mutual_sql())
def mutual_sets(spark, sf_dir):
    return C.mutual_components(brand_nodes(spark, sf_dir), _layers(spark, sf_dir))


#: Depths by walks of up to 20 edges, paths by depth, then all (source, node, target).
_BETWEEN = """,
wk(g, s, v, d) as (select g, v, v, 0 from n union select wk.g, wk.s, b.v, wk.d + 1 from wk join b on b.g = wk.g and b.u = wk.v where wk.d < 20),
ds as (select g, s, v, min(d) d from wk group by 1, 2, 3),
pa(g, s, v, d, p) as (select g, v, v, 0, 1::double from n union all select pa.g, pa.s, b.v, pa.d + 1, sum(pa.p) from pa join b on b.g = pa.g and b.u = pa.v
  join ds on ds.g = pa.g and ds.s = pa.s and ds.v = b.v and ds.d = pa.d + 1 group by pa.g, pa.s, b.v, pa.d),
th as (select a.g, a.v, sum(a.p * c.p / t.p) x from pa a join pa c on c.g = a.g and c.s = a.v join pa t on t.g = a.g and t.s = a.s and t.v = c.v and t.d = a.d + c.d
  where a.s <> a.v and c.v <> a.v and a.s <> c.v group by 1, 2),
nc as (select g, count(*) c from n group by 1)"""


@query(_BETWEEN + " select n.g graph_id, n.v node_id, case when c > 2 then round(coalesce(x, 0) / ((c - 1) * (c - 2)), 9) else 0 end score from n join nc on nc.g = n.g left join th on th.g = n.g and th.v = n.v")
def betweenness_share(spark, sf_dir):
    """Normalised betweenness, exact at any size."""
    return R.betweenness(*_brand(spark, sf_dir), exact_to=None).withColumn("score", _r("score", 9))


_CORE = """, hc(i, g, v, c) as (select 0, g, v, k from d where k > 0 union all
  select i + 1, g, v, max(least(val, cum))::bigint from (select i, g, v, val, sum(held) over (partition by g, v order by val desc) cum from
    (select hc.i, hc.g, hc.v, least(x.c, hc.c) val, count(*) held from hc join b on b.g = hc.g and b.u = hc.v join hc x on x.g = b.g and x.v = b.v group by 1, 2, 3, 4)) where i < 20 group by i, g, v)"""


@query(_CORE + " select n.g graph_id, n.v node_id, coalesce(c, 0)::bigint core from n left join (select g, v, c from hc where i = 20) h on h.g = n.g and h.v = n.v")
def core_numbers(spark, sf_dir):
    return R.core_numbers(*_brand(spark, sf_dir))


_TAKEN = "select i, g, u, v, z, bool_and(m = id) over (partition by i, g, u, v) tk from (select *, min(id) over (partition by i, g, z) m from (select i, g, u, v, u * 1000000000 + v id, unnest([u, v]) z from me))"


@query(f""", me(i, g, u, v) as (select 0, g, u, v from e union all
  select i + 1, g, u, v from (select *, bool_or(tk) over (partition by g, z) hit from ({_TAKEN})) group by i, g, u, v having not bool_or(hit))
  select distinct g graph_id, z node_id, z = u first from ({_TAKEN}) where tk""")
def matching_cover(spark, sf_dir):
    """A vertex cover: both ends of the edges taken in order of their ends."""
    return R.matching_cover(_brand(spark, sf_dir)[1])


@query(" select x.g graph_id, x.u a, x.v b, y.v c from b x join b y on y.g = x.g and y.u = x.v and y.v <> x.u")
def following_edges(spark, sf_dir):
    """Pairs of directed edges that follow each other without turning back."""
    return R.following_edges(_brand(spark, sf_dir)[1])


@query(" select g graph_id, u, v, unnest([u, v]) node_id, unnest([-1, 1])::int way from b")
def edge_incidence(spark, sf_dir):
    return R.edge_ends(_brand(spark, sf_dir)[1])


_BACK = "(select y.g, y.u, y.v, coalesce(sum(x.x), 0) x from b y left join {0} x on x.g = y.g and x.v = y.u and x.u <> y.v group by 1, 2, 3)"


@query(", m0 as (select b.g, b.u, b.v, p_size::double x from b join n on n.g = b.g and n.v = b.u), m1 as " + _BACK.format("m0") + ", m2 as " + _BACK.format("m1") + " select g graph_id, v node_id, sum(x)::double x from m2 group by 1, 2")
def edge_messages(spark, sf_dir):
    """Sizes sent along edges, twice on to edges that follow, and gathered at their heads."""
    return R.gathered(R.edge_message(*_brand(spark, sf_dir), "size", steps=2))


def _sized(spark, sf_dir):
    """A graph a brand, as large as the brand has parts."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("graph_id")).agg(F.count("*").alias("n"))


def _shape(sized, edges):
    """graph_id, n, edges, different edges, least and largest degree."""
    nodes = N.nodes(sized.join(edges.groupBy("graph_id").agg((F.max(F.greatest("src", "dst")) + 1).alias("top")), "graph_id", "left").withColumn("n", F.greatest("n", F.coalesce("top", "n"))))
    degree = G.degree(nodes, edges).groupBy("graph_id").agg(F.count("*").alias("n"), F.min("degree").alias("least"), F.max("degree").alias("most"))
    size = edges.groupBy("graph_id").agg(F.count("*").alias("edges"), F.count_distinct("src", "dst").alias("different"))
    return degree.join(size, "graph_id")


@query("with b as (select p_brand g, count(*) n from part group by 1) select g graph_id, n + n % 2 n, ((n + n % 2) * 3 // 2)::bigint edges, ((n + n % 2) * 3 // 2)::bigint different, 3 least, 3 most from b where n > 3", view=False)
def cubic_graphs(spark, sf_dir):
    """Random graphs of three neighbours a node, a graph a brand."""
    sized = _sized(spark, sf_dir).where("n > 3")
    return _shape(sized, N.regular(sized, 3, seed=1))


@query("with b as (select p_brand g, count(*) n from part group by 1) select g graph_id, n, n - 1 edges, n - 1 different, 1 pieces from b where n > 1", view=False)
def random_trees(spark, sf_dir):
    sized = _sized(spark, sf_dir).where("n > 1")
    edges = N.tree(sized, seed=1)
    shape = _shape(sized, edges).select("graph_id", "n", "edges", "different")
    return shape.join(C.components(N.nodes(sized), edges).groupBy("graph_id").agg(F.count_distinct("label").alias("pieces")), "graph_id")


@query("with b as (select p_brand g, count(*) n from part group by 1) select g graph_id, n, (3 * (n - 3))::bigint edges, (3 * (n - 3))::bigint different, 3 * (n - 3) older from b where n > 3", view=False)
def attachment_graphs(spark, sf_dir):
    """Preferential attachment, three edges a node; ``older`` counts edges to an earlier node."""
    sized = _sized(spark, sf_dir).where("n > 3")
    edges = N.preferential(sized, 3, seed=1)
    older = edges.where("src < dst").groupBy("graph_id").agg(F.count("*").alias("older"))
    return _shape(sized, edges).select("graph_id", "n", "edges", "different").join(older, "graph_id")
