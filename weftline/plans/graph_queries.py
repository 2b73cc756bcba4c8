"""Registered graph queries and the SQL that says the same, over the tables' graph views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import frontier as R
from weftline.operators import graph as G
from weftline.operators import local as L
from weftline.operators import text as T
from weftline.operators import windows as W
from weftline.plans.views import both, brand_edges, brand_nodes, residual, signed, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_VIEW = """
with recursive n as (select p_brand g, p_partkey v, p_size, p_retailprice from part),
op as (select distinct l_orderkey o, l_partkey p, p_brand g from lineitem join part on p_partkey = l_partkey),
e as (select x.g, x.p u, y.p v, count(*) w from op x join op y on x.o = y.o and x.g = y.g and x.p < y.p group by 1, 2, 3),
b as (select g, u, v, w from e union all select g, v, u, w from e),
d as (select n.g, n.v, count(b.v) k, coalesce(sum(b.w), 0)::bigint s from n left join b on b.g = n.g and b.u = n.v group by 1, 2)"""
_COMP = """,
nn as (select g, v from n where {keep}), ee as (select b.g, b.u, b.v from b semi join nn x on x.g = b.g and x.v = b.u semi join nn y on y.g = b.g and y.v = b.v),
r(g, v, m) as (select g, v, v from nn union select ee.g, ee.v, r.m from r join ee on ee.g = r.g and ee.u = r.v),
lab as (select g, v, max(m) l from r group by 1, 2), cs as (select g, l, count(*) c from lab group by 1, 2)"""


def query(sql: str | None = None, view: bool = True):
    def put(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (_VIEW if view else "") + sql
        return f

    return put


def _brand(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return brand_nodes(spark, sf_dir), brand_edges(spark, sf_dir)


def _r(column, n: int = 6):
    return F.round(column, n)


def _chosen(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_id % 3 = 0")


@query(" select g graph_id, v node_id, k degree, s strength from d")
def degree_table(spark, sf_dir):
    return G.degree(*_brand(spark, sf_dir))


@query(" select g graph_id, count(*) nodes, round(sum(p_retailprice), 4) total, round(avg(p_retailprice), 6) mean, max(p_retailprice) top from n group by 1")
def graph_pool_stats(spark, sf_dir):
    n = brand_nodes(spark, sf_dir)
    return n.groupBy("graph_id").agg(F.count("*").alias("nodes"), _r(F.sum("price"), 4).alias("total"), _r(F.avg("price")).alias("mean"), F.max("price").alias("top"))


@query(" select n.g graph_id, n.v node_id, coalesce(round(avg(m.p_retailprice), 6), 0) mean, coalesce(max(m.p_retailprice), 0) high, coalesce(min(m.p_retailprice), 0) low from n left join b on b.g = n.g and b.u = n.v left join n m on m.v = b.v group by 1, 2")
def neighbour_mean_max_min(spark, sf_dir):
    n, e = _brand(spark, sf_dir)
    return G.neighbour_agg(n, e, "price", mean=_r(F.avg("x")), high=F.max("x"), low=F.min("x"))


@query(" select g graph_id, v node_id, round(exp(p_size - max(p_size) over (partition by g)) / sum(exp(p_size - m)) over (partition by g), 9) p from (select *, max(p_size) over (partition by g) m from n)")
def segment_softmax(spark, sf_dir):
    n = brand_nodes(spark, sf_dir).withColumn("score", F.col("size").cast("double"))
    return G.softmax(n).select("graph_id", "node_id", _r(F.col("p"), 9).alias("p"))


@query(" , q as (select g, exp(p_size / 10.0::double) / sum(exp(p_size / 10.0::double)) over (partition by g) p from n) select g graph_id, round(-sum(p * ln(p)), 6) entropy from q group by 1")
def segment_entropy(spark, sf_dir):
    n = brand_nodes(spark, sf_dir).withColumn("score", F.col("size") / 10)
    return G.softmax(n).groupBy("graph_id").agg(_r(-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


@query(" select x.g graph_id, coalesce(y.v, -1) node_id from (select distinct g from n) x left join (select g, v from (select *, row_number() over (partition by g order by p_retailprice desc, v) rn from n where p_size > 20) where rn = 1) y on y.g = x.g")
def argmax_per_graph(spark, sf_dir):
    n = brand_nodes(spark, sf_dir)
    return G.argmax(n, n.where("size > 20").withColumn("score", F.col("price")))


@query(" select g graph_id, c size, (sum(c) over (order by g) - c)::bigint ptr from (select g, count(*) c from n group by 1)")
def csr_ptr(spark, sf_dir):
    size = brand_nodes(spark, sf_dir).groupBy("graph_id").agg(F.count("*").alias("size"))
    return size.withColumn("ptr", F.coalesce(F.sum("size").over(Window.orderBy("graph_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


@query(" select g graph_id, u src, v dst, w weight from e where u % 3 <> 0 and v % 3 <> 0")
def residual_subgraph(spark, sf_dir):
    n, e = _brand(spark, sf_dir)
    return residual(n, e, _chosen(n))[1].select("graph_id", "src", "dst", "weight")


@query(" select e.g graph_id, e.u src, e.v dst, round(1 / sqrt((a.k + 1) * (c.k + 1)), 9) c from e join d a on a.g = e.g and a.v = e.u join d c on c.g = e.g and c.v = e.v")
def gcn_norm_coeff(spark, sf_dir):
    n, e = _brand(spark, sf_dir)
    of = G.edge_states(e, G.degree(n, e), "degree")
    return of.select("graph_id", "src", "dst", _r(1 / F.sqrt((F.col("a") + 1) * (F.col("b") + 1)), 9).alias("c"))


@query(_COMP.format(keep="true") + " select g graph_id, v node_id, l label from lab")
def components(spark, sf_dir):
    return G.components(*_brand(spark, sf_dir))


_CONN = " select g graph_id, count(*) components, max(c) largest, sum(c * (c - 1) // 2)::bigint pairs from cs group by 1"


@query(_COMP.format(keep="true") + _CONN)
def pairwise_connectivity(spark, sf_dir):
    return G.connectivity(*_brand(spark, sf_dir))


@query(_COMP.format(keep="v % 3 <> 0") + _CONN)
def connectivity_after_removal(spark, sf_dir):
    n, e = _brand(spark, sf_dir)
    return G.connectivity(*residual(n, e, _chosen(n)))


@query(", t as (select g, v from (select *, row_number() over (partition by g order by k desc, v) rn, count(*) over (partition by g) c from d) where rn <= greatest(1, c // 10))" + _COMP.format(keep="not exists (select 1 from t where t.g = n.g and t.v = n.v)") + _CONN)
def dismantle_degree(spark, sf_dir):
    """The top tenth by degree of each graph is removed; what stays connected."""
    n, e = _brand(spark, sf_dir)
    most = G.degree(n, e).withColumn("most", F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy("graph_id")) / 10)))
    return G.connectivity(*residual(n, e, G.top_by(most, "degree", F.col("most"))))


@query(" select g graph_id, v node_id, k degree, rn rank from (select *, row_number() over (partition by g order by k desc, v) rn from d) where rn <= 5")
def topk_degree(spark, sf_dir):
    return G.top_by(G.degree(*_brand(spark, sf_dir)), "degree", 5).select("graph_id", "node_id", "degree", "rank")


@query(_COMP.format(keep="true") + ", t as (select g, l from (select *, row_number() over (partition by g order by c desc, l) rn from cs) where rn = 1) select lab.g graph_id, lab.v node_id, dense_rank() over (partition by lab.g order by lab.v) - 1 new_id from lab join t on t.g = lab.g and t.l = lab.l")
def largest_component_extract(spark, sf_dir):
    of = G.components(*_brand(spark, sf_dir))
    size = of.groupBy("graph_id", "label").agg(F.count("*").alias("n"))
    best = size.groupBy("graph_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    new = F.dense_rank().over(Window.partitionBy("graph_id").orderBy("node_id")) - 1
    return of.join(best, ["graph_id", "label"]).select("graph_id", "node_id", new.alias("new_id"))


@query(" select g graph_id, sum(case when u % 2 <> v % 2 then w else 0 end)::bigint cut, sum(case when u % 3 <> v % 3 then w else 0 end)::bigint kcut, count(*) filter (u % 3 = v % 3) conflicts from e group by 1")
def partition_values(spark, sf_dir):
    """Two-way cut, three-way cut and same-label edges of a fixed labelling."""
    e = brand_edges(spark, sf_dir)
    same = lambda k: F.col("src") % k == F.col("dst") % k
    return e.groupBy("graph_id").agg(F.sum(F.when(~same(2), F.col("weight")).otherwise(0)).alias("cut"), F.sum(F.when(~same(3), F.col("weight")).otherwise(0)).alias("kcut"), F.sum(same(3).cast("long")).alias("conflicts"))


_SIGN = ", sg as (select g, u, v, case when (u * 31 + v) % 2 = 0 then 1 else -1 end w from e), sb as (select g, u, v, w from sg union all select g, v, u, w from sg)"


@query(_SIGN + " select g graph_id, sum(w * (1 - 2 * (u % 2)) * (1 - 2 * (v % 2)))::bigint energy from sg group by 1")
def ising_energy(spark, sf_dir):
    e = signed(brand_edges(spark, sf_dir))
    return e.groupBy("graph_id").agg(F.sum(F.col("weight") * (1 - 2 * (F.col("src") % 2)) * (1 - 2 * (F.col("dst") % 2))).alias("energy"))


@query(_SIGN + " select n.g graph_id, n.v node_id, coalesce(-2 * (1 - 2 * (n.v % 2)) * sum(w * (1 - 2 * (sb.v % 2))), 0)::bigint gain from n left join sb on sb.g = n.g and sb.u = n.v group by 1, 2")
def flip_gain(spark, sf_dir):
    n, e = _brand(spark, sf_dir)
    spin = lambda c: 1 - 2 * (F.col(c) % 2)
    field = both(signed(e)).groupBy("graph_id", F.col("u").alias("node_id")).agg(F.sum(F.col("weight") * spin("v")).alias("f"))
    return n.join(field, G.KEY, "left").select(*G.KEY, F.coalesce(-2 * spin("node_id") * F.col("f"), F.lit(0)).cast("long").alias("gain"))


@query(" select g graph_id, count(*) filter (u % 3 <> 0 and v % 3 <> 0) uncovered, count(*) filter (u % 3 = 0 and v % 3 = 0) violations from e group by 1")
def cover_and_independence(spark, sf_dir):
    """Edges that a fixed set leaves uncovered, and edges inside it."""
    e = brand_edges(spark, sf_dir)
    a, b = F.col("src") % 3 == 0, F.col("dst") % 3 == 0
    return e.groupBy("graph_id").agg(F.sum((~a & ~b).cast("long")).alias("uncovered"), F.sum((a & b).cast("long")).alias("violations"))


@query(" select g graph_id, sum(k + 1)::bigint value from d where v % 3 = 0 group by 1")
def mwis_value(spark, sf_dir):
    return _chosen(G.degree(*_brand(spark, sf_dir))).groupBy("graph_id").agg(F.sum(F.col("degree") + 1).alias("value"))


@query(" select n.g graph_id, count(*) filter (n.v % 7 = 0 or exists (select 1 from b where b.g = n.g and b.u = n.v and b.v % 7 = 0)) dominated, count(*) nodes from n group by 1")
def dominated_nodes(spark, sf_dir):
    n, e = _brand(spark, sf_dir)
    hit = both(e).where("v % 7 = 0").select("graph_id", F.col("u").alias("node_id")).union(n.where("node_id % 7 = 0").select(*G.KEY)).distinct()
    return n.join(hit.withColumn("d", F.lit(1)), G.KEY, "left").groupBy("graph_id").agg(F.count("d").alias("dominated"), F.count("*").alias("nodes"))


@query("with s as (select distinct l_suppkey s, l_partkey p from lineitem), c as (select distinct p from s where s % 5 = 0) select s supplier, count(*) gain from s anti join c on c.p = s.p group by 1", view=False)
def set_cover_gain(spark, sf_dir):
    """Elements (parts) that each set (supplier) would add to those covered already."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part")).distinct()
    return s.join(s.where("supplier % 5 = 0").select("part").distinct(), "part", "left_anti").groupBy("supplier").agg(F.count("*").alias("gain"))


_MOD = ", m as (select g, sum(w)::double w2 from b group by 1), t as (select d.g, sum(s * (1 - 2 * (v % 2)))::double ks from d group by 1), c as (select g, sum(w * (1 - 2 * (u % 2)) * (1 - 2 * (v % 2)))::double a from b group by 1)"


@query(_MOD + " select m.g graph_id, round((a - ks * ks / w2) / (2 * w2), 9) q from m join t on t.g = m.g join c on c.g = m.g")
def modularity_q(spark, sf_dir):
    n, e = _brand(spark, sf_dir)
    spin = lambda c: 1 - 2 * (F.col(c) % 2)
    inner = e.groupBy("graph_id").agg(F.sum("weight").alias("m"), F.sum(F.col("weight") * spin("src") * spin("dst")).alias("a"))
    outer = G.degree(n, e).groupBy("graph_id").agg(F.sum(F.col("strength") * spin("node_id")).alias("k"))
    two = 2 * F.col("m")
    return inner.join(outer, "graph_id").select("graph_id", _r((2 * F.col("a") - F.col("k") * F.col("k") / two) / (2 * two), 9).alias("q"))


@query(", k as (select g, count(*) c, sum(1 - 2 * (v % 2))::double s from n group by 1), c as (select g, sum(case when u % 2 <> v % 2 then w else 0 end) cut from e group by 1) select k.g graph_id, round(coalesce(cut, 0) + s * s / c, 6) cost from k left join c on c.g = k.g")
def balanced_cost(spark, sf_dir):
    n, e = _brand(spark, sf_dir)
    size = n.groupBy("graph_id").agg(F.count("*").alias("c"), F.sum(1 - 2 * (F.col("node_id") % 2)).alias("s"))
    cut = e.where("src % 2 != dst % 2").groupBy("graph_id").agg(F.sum("weight").alias("cut"))
    return size.join(cut, "graph_id", "left").select("graph_id", _r(F.coalesce("cut", F.lit(0)) + F.col("s") * F.col("s") / F.col("c")).alias("cost"))


@query(" select n.g graph_id, n.v node_id, count(b.v) filter (b.v % 3 = 0) c0, count(b.v) filter (b.v % 3 = 1) c1, count(b.v) filter (b.v % 3 = 2) c2 from n left join b on b.g = n.g and b.u = n.v group by 1, 2")
def neighbour_colour_hist(spark, sf_dir):
    n, e = _brand(spark, sf_dir)
    of = both(e).groupBy("graph_id", F.col("u").alias("node_id")).agg(*[F.sum((F.col("v") % 3 == k).cast("long")).alias(f"c{k}") for k in range(3)])
    return G._dense(n, of, c0=0, c1=0, c2=0)


_CI = ", c1 as (select d.g, d.v, d.k, coalesce(sum(greatest(x.k - 1, 0)), 0)::bigint f from d left join b on b.g = d.g and b.u = d.v left join d x on x.g = b.g and x.v = b.v group by 1, 2, 3)"


@query(_CI + " select c1.g graph_id, c1.v node_id, ((greatest(c1.k - 1, 0)) * c1.f)::bigint ci1, (greatest(c1.k - 1, 0) * coalesce(sum(x.f), 0))::bigint ci2 from c1 left join b on b.g = c1.g and b.u = c1.v left join c1 x on x.g = b.g and x.v = b.v group by c1.g, c1.v, c1.k, c1.f")
def collective_influence(spark, sf_dir):
    """CI over neighbours, and over walks of length two (which may turn back)."""
    n, e = _brand(spark, sf_dir)
    deg = G.degree(n, e).select(*G.KEY, F.greatest(F.col("degree") - 1, F.lit(0)).alias("r"))
    one = deg.join(G.neighbour_agg(deg, e, "r", f=F.sum("x")), G.KEY)
    two = G.neighbour_agg(one, e, "f", f2=F.sum("x"))
    return one.join(two, G.KEY).select(*G.KEY, (F.col("r") * F.col("f")).alias("ci1"), (F.col("r") * F.col("f2")).alias("ci2"))


@query(" select x.g graph_id, round((select count(*) from n where n.g = x.g and n.v % 3 = 0)::double / c, 9) removed, round(coalesce(cov, 0)::double / ec, 9) covered, round(tw::double / (c * c), 9) two_hop from (select g, count(*) c from n group by 1) x join (select g, count(*) ec, count(*) filter (u % 3 = 0 or v % 3 = 0) cov from e group by 1) y on y.g = x.g join (select g, sum(k * (k - 1) // 2) tw from d group by 1) z on z.g = x.g")
def dismantling_features(spark, sf_dir):
    n, e = _brand(spark, sf_dir)
    a = n.groupBy("graph_id").agg(F.count("*").alias("n"), F.sum((F.col("node_id") % 3 == 0).cast("long")).alias("gone"))
    b = e.groupBy("graph_id").agg(F.count("*").alias("m"), F.sum(((F.col("src") % 3 == 0) | (F.col("dst") % 3 == 0)).cast("long")).alias("cov"))
    c = G.degree(n, e).groupBy("graph_id").agg(F.sum(F.expr("degree * (degree - 1) div 2")).alias("tw"))
    x = a.join(b, "graph_id").join(c, "graph_id")
    return x.select("graph_id", _r(F.col("gone") / F.col("n"), 9).alias("removed"), _r(F.col("cov") / F.col("m"), 9).alias("covered"), _r(F.col("tw") / (F.col("n") * F.col("n")), 9).alias("two_hop"))


@query(" select d.g graph_id, d.v node_id, round(ln(1 + d.k), 9) own, round(ln(1 + coalesce(avg(x.k), 0)), 9) mean, round(ln(1 + coalesce(max(x.k), 0)), 9) high, round(ln(1 + coalesce(sum(x.k), 0)), 9) two_hop from d left join b on b.g = d.g and b.u = d.v left join d x on x.g = b.g and x.v = b.v group by d.g, d.v, d.k")
def structural_pe(spark, sf_dir):
    n, e = _brand(spark, sf_dir)
    deg = G.degree(n, e)
    of = deg.join(G.neighbour_agg(deg, e, "degree", mean=F.avg("x"), high=F.max("x"), total=F.sum("x")), G.KEY)
    return of.select(*G.KEY, *[_r(F.log1p(F.col(c)), 9).alias(k) for c, k in (("degree", "own"), ("mean", "mean"), ("high", "high"), ("total", "two_hop"))])


_P = "(select d.g, d.v, (1 / sqrt(d.k + 1)) * (coalesce(sum(y.x / sqrt(y.k + 1)), 0) + any_value(z.x) / sqrt(d.k + 1)) x, d.k from d join {0} z on z.g = d.g and z.v = d.v left join b on b.g = d.g and b.u = d.v left join {0} y on y.g = b.g and y.v = b.v group by d.g, d.v, d.k)"
_X0 = ", x0 as (select d.g, d.v, p_size::double x, k from d join n on n.v = d.v), p1 as " + _P.format("x0")


@query(_X0 + ", p2 as " + _P.format("p1") + " select g graph_id, v node_id, round(x, 6) x from p2")
def sgc_propagation(spark, sf_dir):
    n, e = _brand(spark, sf_dir)
    return G.propagate(n, e, "size", 2).withColumn("x", _r("x"))


@query(_X0 + ", a1 as (select p1.g, p1.v, 0.9::double * p1.x + 0.1::double * x0.x x, p1.k from p1 join x0 on x0.v = p1.v), p2 as " + _P.format("a1") + " select p2.g graph_id, p2.v node_id, round(0.9::double * p2.x + 0.1::double * x0.x, 6) x from p2 join x0 on x0.v = p2.v")
def appnp_propagation(spark, sf_dir):
    n, e = _brand(spark, sf_dir)
    return G.propagate(n, e, "size", 2, keep=0.1).withColumn("x", _r("x"))


@query(" select n.g graph_id, n.v node_id, coalesce(round(avg(m.p_size), 6), 0) mean, coalesce(max(m.p_size), 0) high, coalesce(min(m.p_size), 0) low, coalesce(round(stddev_pop(m.p_size), 6), 0) sd from n left join b on b.g = n.g and b.u = n.v left join n m on m.v = b.v group by 1, 2")
def pna_stats(spark, sf_dir):
    n, e = _brand(spark, sf_dir)
    return G.neighbour_agg(n, e, "size", mean=_r(F.avg("x")), high=F.max("x"), low=F.min("x"), sd=_r(F.stddev_pop("x")))


@query(" select g graph_id, v node_id, round(k / greatest(max(k) over (partition by g), 1)::double, 9) cost from d")
def node_cost_degree(spark, sf_dir):
    top = F.greatest(F.max("degree").over(Window.partitionBy("graph_id")), F.lit(1))
    return G.degree(*_brand(spark, sf_dir)).select(*G.KEY, _r(F.col("degree") / top, 9).alias("cost"))


@query(", op2 as (select l_orderkey o, g, array_agg(distinct p order by p) ps from (select distinct l_orderkey, l_partkey p, p_brand g from lineitem join part on p_partkey = l_partkey) group by 1, 2 having count(*) > 1) select count(*) hyperedges, sum(len(ps))::bigint members, max(len(ps))::bigint largest from op2")
def brand_hyperedges(spark, sf_dir):
    """Hyperedges: parts of one brand in one order, two or more."""
    of = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct().join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.col("p_brand").alias("g")), "p")
    size = of.groupBy("o", "g").agg(F.count("*").alias("k")).where("k > 1")
    return size.agg(F.count("*").alias("hyperedges"), F.sum("k").alias("members"), F.max("k").alias("largest"))


@query("with r as (select event_id, user_id, value, row_number() over (partition by user_id order by ts, event_id) i from events), t as (select *, lead(value, 1) over w a, lead(value, 2) over w c, lead(value, 3) over w d from r window w as (partition by user_id order by i)) select event_id, round(value + 0.9::double * coalesce(a, 0) + 0.81::double * coalesce(c, 0), 6) nstep_return, d is null terminal from t", view=False)
def nstep_return(spark, sf_dir):
    return W.nstep(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 3, 0.9).select("event_id", _r("nstep_return").alias("nstep_return"), "terminal")


@query("select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between current row and 2 following), 6) difference, max(value) over (partition by user_id order by ts, event_id rows unbounded preceding) best, round(avg(value) over (partition by user_id order by ts, event_id rows 99 preceding), 9) average from events", view=False)
def window_returns(spark, sf_dir):
    """Suffix-sum differences, running best and moving average of 100 (to 9 places: means of cents can end on a 5 in the seventh)."""
    key, order = "user_id", ["ts", "event_id"]
    e = table(spark, sf_dir, "events")
    out = W.moving_average(W.running_best(W.suffix_difference(e, key, order, "value", 3), key, order, "value"), key, order, "value", 100)
    return out.select("event_id", _r("difference").alias("difference"), "best", _r("average", 9).alias("average"))


@query("select event_id, round((value - avg(value) over w) / sqrt(var_pop(value) over w + 1e-6), 6) z from events window w as (partition by event_type)", view=False)
def standardise(spark, sf_dir):
    return W.standardise(table(spark, sf_dir, "events"), "event_type", "value").select("event_id", _r("z").alias("z"))


@query(r"with l as (select distinct doc_id, unnest(string_split(text, chr(10))) line from documents), k as (select lower(trim(regexp_replace(regexp_replace(line, '\p{Nd}+', '#', 'g'), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g'))) key from l) select key, count(*) n from k where length(key) >= 4 group by 1 having count(*) >= (select greatest(3, floor(count(distinct doc_id) * 0.01)) from l)", view=False)
def furniture_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("line"))
    return T.furniture(lines, share=0.01)


@query("select n_nationkey nation, count(distinct p_brand) brands, min(p_brand) first_brand from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey group by 1", view=False)
def nation_domains(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    rows = t("nation").join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("orders"), F.col("o_custkey") == F.col("c_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy(F.col("n_nationkey").alias("nation")).agg(F.countDistinct("p_brand").alias("brands"), F.min("p_brand").alias("first_brand"))


@query("with p as (select distinct least(l_partkey, l_suppkey) u, greatest(l_partkey, l_suppkey) v from lineitem where l_partkey <> l_suppkey) select u src, v dst from p", view=False)
def edge_canonicalise(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_partkey != l_suppkey").select(F.least("l_partkey", "l_suppkey").alias("src"), F.greatest("l_partkey", "l_suppkey").alias("dst")).distinct()


@query(", x as (select e.*, unnest([u, v]) z from e) select distinct a.g graph_id, a.u src1, a.v dst1, c.u src2, c.v dst2 from x a join x c on a.g = c.g and a.z = c.z and (a.u < c.u or a.u = c.u and a.v < c.v)")
def line_graph_edges(spark, sf_dir):
    return G.line_graph(brand_edges(spark, sf_dir))


def _pair_view(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Per user: event types as nodes, consecutive types as edges."""
    ev = table(spark, sf_dir, "events")
    code = ev.select("user_id", F.crc32(F.col("event_type").cast("binary")).cast("long").alias("node_id"), "ts", "event_id")
    after = code.withColumn("next", F.lead("node_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("next is not null and next != node_id")
    e = after.groupBy(F.col("user_id").alias("graph_id"), F.least("node_id", "next").alias("src"), F.greatest("node_id", "next").alias("dst")).agg(F.count("*").alias("weight"))
    return code.select(F.col("user_id").alias("graph_id"), "node_id").distinct(), e


@query()
def best_cut(spark, sf_dir):
    n, e = _pair_view(spark, sf_dir)
    return L.per_graph(n, e, L.best_cut, "graph_id long, n long, cut double")


def _kernel(name: str, schema: str):
    def run(spark, sf_dir):
        n, e = _brand(spark, sf_dir)
        return L.per_graph(n, e, getattr(L, name), f"graph_id string, {schema}")

    run.__name__ = name
    QUERIES[name] = run


_kernel("robustness", "n long, nd double, cn double")
_kernel("greedy_cover", "step long, node_id long")
_kernel("reinsertion", "step long, node_id long")


@query()
def betweenness(spark, sf_dir):
    """Brandes' shortest-path betweenness of every node, each pair once."""
    n, e = _brand(spark, sf_dir)
    of = R.betweenness(n, e, exact_to=None, share=False)
    return of.select("graph_id", "node_id", (F.col("score") / 2).alias("score"))
