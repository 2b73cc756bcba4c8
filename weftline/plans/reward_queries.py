"""Registered queries of removal rewards, residual states, move values and marked-up text."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import graph as G
from weftline.plans.graph_queries import _COMP, _brand, _chosen, _r, query
from weftline.plans.views import both, residual, table


@query(" select d.g graph_id, d.v node_id, (any_value(d.k) - count(b.v) filter (b.v % 3 = 0))::bigint score from d left join b on b.g = d.g and b.u = d.v where d.v % 3 <> 0 group by 1, 2")
def influence_degree(spark, sf_dir):
    """Degree less the neighbours among the seeds (every third node), of nodes that are no seeds."""
    n, e = _brand(spark, sf_dir)
    return G.seed_discount(n, e, _chosen(n))


_FLIP = ", m as (select g, sum(w)::double w2 from b group by 1), t as (select g, sum(s * (1 - 2 * (v % 2)))::double ks from d group by 1), f as (select d.g, d.v, d.s::double s, 1 - 2 * (d.v % 2) x, coalesce(sum(b.w * (1 - 2 * (b.v % 2))), 0)::double f from d left join b on b.g = d.g and b.u = d.v group by d.g, d.v, d.s)"


@query(_FLIP + " select f.g graph_id, f.v node_id, round(-2 * x * (f - s * (ks - s * x) / w2) / w2 + 0.0::double, 9) dq from f join m on m.g = f.g join t on t.g = f.g")
def modularity_delta(spark, sf_dir):
    """The change of modularity when one node changes sides of a fixed split."""
    n, e = _brand(spark, sf_dir)
    return G.modularity_delta(n, e, 1 - 2 * (F.col("node_id") % 2)).withColumn("dq", _r(F.col("dq") + 0.0, 9))


@query(", a as (select g, v from (select *, row_number() over (partition by g order by k desc, v) rn from d) where rn = 1)" + _COMP.format(keep="not exists (select 1 from a where a.g = n.g and a.v = n.v)")
       + ", h as (select g, max(c)::double lcc, sum(c * (c - 1) // 2)::double pairs from cs group by 1), z as (select n.g, count(*)::double c, sum(p_size)::double w, sum(p_size) filter (exists (select 1 from a where a.g = n.g and a.v = n.v))::double wa from n group by 1)"
       " select z.g graph_id, round(-coalesce(lcc, 0) / (c * c), 9) nd, round(-coalesce(lcc, 0) / c * (wa / w), 9) nd_cost, round(-coalesce(pairs, 0) / (c * (c * (c - 1) / 2)), 9) cn from z left join h on h.g = z.g where c > 1")  # fmt: skip
def removal_rewards(spark, sf_dir):
    """Rewards for removing each graph's node of highest degree; sizes are the costs."""
    n, e = _brand(spark, sf_dir)
    first = G.top_by(G.degree(n, e), "degree", 1).select(*G.KEY)
    of = G.removal_rewards(n, e, first, "size")
    return of.select("graph_id", *[_r(c, 9).alias(c) for c in ("nd", "nd_cost", "cn")])


@query(", r as (select * from b where u % 3 <> 0 and v % 3 <> 0), rd as (select g, u, count(*) k from r group by 1, 2), rs as (select g, count(*) c, sum(k * (k - 1) // 2)::bigint h from rd group by 1), x as (select g, count(*) filter (u % 3 = 0 or v % 3 = 0) covered from e group by 1) select x.g graph_id, covered, coalesce(c, 0) nodes, coalesce(h, 0) two_hop from x left join rs on rs.g = x.g")
def residual_status(spark, sf_dir):
    """Edges that the removed nodes cover, nodes with an edge left, and paths of two edges left."""
    n, e = _brand(spark, sf_dir)
    return G.residual_status(e, residual(n, e, _chosen(n))[1])


@query(", p as (select distinct x.g, x.v, y.v z from b x join b y on x.g = y.g and x.u = y.u and x.v < y.v where x.v % 3 <> 0 and y.v % 3 <> 0) select n.g graph_id, count(p.v) pairs from (select distinct g from n) n left join p on p.g = n.g group by 1")
def uncovered_pairs(spark, sf_dir):
    """Pairs of remaining nodes with a neighbour, removed or not, in common."""
    n, e = _brand(spark, sf_dir)
    return G.pairs_near(n, e, _chosen(n))


@query(" select n.g graph_id, median(d.k) middle, median(p_size) size from n join d on d.v = n.v group by 1")
def median_degree(spark, sf_dir):
    """Medians that average the two middle values."""
    n, e = _brand(spark, sf_dir)
    return G.degree(n, e).join(n, G.KEY).groupBy("graph_id").agg(F.median("degree").alias("middle"), F.median("size").alias("size"))


_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(rf"select conv_id, turn, regexp_replace(regexp_replace({_ESCAPED}, '\*\*([^\n\r\x{{2028}}\x{{2029}}]+?)\*\*', '<b>\1</b>', 'g'), '`([^\n\r\x{{2028}}\x{{2029}}]+?)`', '<code>\1</code>', 'g') html, coalesce(regexp_full_match(text, '\p{{Nd}}+'), false) digits from conversations", view=False)
def inline_markup(spark, sf_dir):
    """Texts as HTML with bold and code spans, and whether they are digits alone."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", S.inline_html(F.col("text")).alias("html"), F.coalesce(S.all_digits(F.col("text")), F.lit(False)).alias("digits"))
