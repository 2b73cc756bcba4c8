"""Registered queries of learning targets, segment reductions and method tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graph as G
from weftline.operators import layout as P
from weftline.operators import learners as T
from weftline.operators import returns as R
from weftline.operators import segments as S
from weftline.operators import text as X
from weftline.plans.graph_queries import _brand, _r, query
from weftline.plans.views import brand_nodes, table

_E = "with recursive ev as (select event_id, user_id, value / 100 r, event_id % 7 / 7::double v, row_number() over (partition by user_id order by ts desc, event_id desc) i from events)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("value") / 100).alias("r"), (F.col("event_id") % 7 / 7).alias("v"))


@query(
    _E + ", g(user_id, i, event_id, v, a) as (select user_id, i, event_id, v, r - v from ev where i = 1 union all select e.user_id, e.i, e.event_id, e.v, e.r + 0.99::double * g.v - e.v + 0.99::double * 0.95::double * g.a from g join ev e on e.user_id = g.user_id and e.i = g.i + 1) "
    "select event_id, round(a, 6) advantage, round(a + v, 6) target from g",
    view=False,
)
def gae(spark, sf_dir):
    """Advantages and targets of every user's events as an episode."""
    return R.gae(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "r", "v").select("event_id", _r("advantage").alias("advantage"), _r("target").alias("target"))


@query(
    "with e as (select event_id, pow(least(abs(value) / 500 + 1e-7, 1), 0.6) p from events), t as (select sum(p) t, min(p) m from e), s as (select *, sum(p) over (order by event_id) hi from e), "
    "d as (select unnest(range(0, 64)) draw) select draw, event_id, round(pow(p / m, -0.4), 6) is_weight from d, t join s on (draw + 0.5::double) * t / 64 > hi - p and (draw + 0.5::double) * t / 64 <= hi",
    view=False,
)
def prioritised_draws(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", R.priorities(F.col("value") / 500).alias("p"))
    return R.prioritised_draw(e, "event_id", "p", 64).select("draw", "event_id", _r("is_weight").alias("is_weight"))


@query(
    "with e as (select event_id, value / 100 r, unnest(range(0, 11)) a from events), t as (select event_id, a, least(greatest(r + 0.9::double * (a * 2 - 10), -10), 10) z from e), "
    "b as (select event_id, (z + 10) / 2 x, least(floor((z + 10) / 2), 9) lo from t), m as (select event_id, lo a, (lo + 1 - x) / 11 p from b union all select event_id, lo + 1, (x - lo) / 11 from b) "
    "select event_id, a::bigint atom, round(sum(p), 9) p from m group by 1, 2",
    view=False,
)
def distribution_projection(spark, sf_dir):
    """Uniform mass on 11 atoms, moved by reward and discount."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("a")).withColumns({"p": F.lit(1 / 11), "g": F.lit(0.9)})
    return R.projected_distribution(e, ["event_id"], "a", "p", "r", "g", 11).select("event_id", F.col("atom").cast("long").alias("atom"), _r("p", 9).alias("p"))


@query(", q as (select g, v, p_size / 50::double x, max(p_size / 50::double) over (partition by g) m from n), z as (select *, m + 0.5::double * ln(sum(exp((x - m) / 0.5::double)) over (partition by g)) sv from q) select g graph_id, v node_id, round(sv, 6) soft_value, round(greatest(x - sv, -1), 6) log_policy from z")
def soft_values(spark, sf_dir):
    n = brand_nodes(spark, sf_dir).select("graph_id", "node_id", (F.col("size") / 50).alias("x"))
    return R.soft_value(n, "graph_id", "x", 0.5).select("graph_id", "node_id", _r("soft_value").alias("soft_value"), _r("log_policy").alias("log_policy"))


@query("select event_id, round(value - avg(value) over (partition by user_id), 10) advantage from events", view=False)
def group_advantage(spark, sf_dir):
    return R.group_advantage(table(spark, sf_dir, "events"), "user_id", "value").select("event_id", _r("advantage", 10).alias("advantage"))


@query(
    "with m as (select event_type method, count(value) graphs, avg(value) mean, stddev_samp(value) deviation from events group by 1), b as (select max(mean) b from m) "
    "select method, graphs, round(mean, 6) mean, round(deviation, 6) deviation, rank() over (order by mean desc) rank, round(case when b <> 0 then 100 * (b - mean) / abs(b) when b = mean then 0 else 'inf'::double end, 6) gap from m, b",
    view=False,
)
def method_table(spark, sf_dir):
    """Event types as methods, ranked by mean value with the gap to the best."""
    of = R.ranked_methods(table(spark, sf_dir, "events"), "event_type", "value", True)
    return of.select(F.col("event_type").alias("method"), "graphs", _r("mean").alias("mean"), _r("deviation").alias("deviation"), "rank", _r("gap").alias("gap"))


@query("select user_id, max(value) value, count(*) tried from events group by 1", view=False)
def best_decoded(spark, sf_dir):
    return R.best_of(table(spark, sf_dir, "events"), "user_id", "value")


@query("select event_id, value from events order by event_id desc limit 500", view=False)
def replay_content(spark, sf_dir):
    """A ring buffer of 500 rows: the limit is its capacity."""
    return R.last_rows(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 500)


@query("select user_id, round(avg(value) / (stddev_samp(value) / sqrt(count(*))), 6) t from events group by 1", view=False)
def t_statistics(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(_r(R.t_statistic("value")).alias("t"))


@query("select event_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::int earlier from events", view=False)
def prefix_states(spark, sf_dir):
    of = R.prefix_state(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    return of.select("event_id", F.size("selected").alias("earlier"))


@query(", s as (select g, v % 4 k, sum(p_size) s, avg(p_size) m, max(p_size) h, min(p_size) l from n where v % 5 = 0 group by 1, 2), k as (select distinct g, unnest(range(0, 4)) k from n) select k.g graph_id, k.k bucket, coalesce(s, 0)::double total, coalesce(round(m, 6), 0) mean, coalesce(h, 0)::double high, coalesce(l, 0)::double low from k left join s on s.g = k.g and s.k = k.k")
def scatter_reductions(spark, sf_dir):
    """Sum, mean, max and min by bucket, dense over four buckets a graph."""
    n = brand_nodes(spark, sf_dir)
    every = n.select("graph_id").distinct().select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("bucket")).withColumn("_i", F.struct("graph_id", "bucket"))
    rows = n.where("node_id % 5 = 0").select(F.struct("graph_id", (F.col("node_id") % 4).alias("bucket")).alias("_i"), F.col("size").cast("double").alias("x"))
    out = every
    for how, name in (("sum", "total"), ("mean", "mean"), ("max", "high"), ("min", "low")):
        out = out.join(S.scatter(rows, every, "_i", "x", how).select("_i", _r("x").alias(name)), "_i")
    return out.drop("_i")


@query(" select g graph_id, round(m + ln(sum(exp(x - m))), 6) lse from (select g, p_size / 10::double x, max(p_size / 10::double) over (partition by g) m from n) group by g, m")
def log_sum_exp(spark, sf_dir):
    n = brand_nodes(spark, sf_dir).withColumn("x", F.col("size") / 10)
    return S.log_sum_exp(n, "graph_id", "x").withColumn("lse", _r("lse"))


@query(" select g graph_id, min(v) filter (v % 3 = 0) is null none, round(coalesce(any_value(x - l) filter (v = a), 0), 6) log_p from (select n.g, v, p_size / 10::double x, ln(sum(exp(p_size / 10::double)) over (partition by n.g)) l, min(case when v % 3 = 0 then v end) over (partition by n.g) a from n) group by 1")
def action_log_p(spark, sf_dir):
    """log probability of each graph's smallest node divisible by 3."""
    n = brand_nodes(spark, sf_dir).withColumn("x", F.col("size") / 10)
    a = n.groupBy("graph_id").agg(F.coalesce(F.min(F.when(F.col("node_id") % 3 == 0, F.col("node_id"))), F.lit(-1)).alias("action"))
    return S.chosen_log_p(n, "graph_id", "node_id", "x", a).select("graph_id", (F.col("action") == -1).alias("none"), _r("log_p").alias("log_p"))


@query()
def sampled_action(spark, sf_dir):
    return S.sampled(brand_nodes(spark, sf_dir).withColumn("x", F.col("size") / 10), "graph_id", "node_id", "x", 7)


@query()
def permuted_copies(spark, sf_dir):
    """Two relabelled copies of every graph's edges."""
    n, e = _brand(spark, sf_dir)
    new = S.permuted(n, 3)
    to = lambda c: new.select("graph_id", F.col("node_id").alias(c), F.col("new_id").alias(f"new_{c}"))
    return S.repeated(e.join(to("src"), ["graph_id", "src"]).join(to("dst"), ["graph_id", "dst"]), 2).select("graph_id", "copy", F.least("new_src", "new_dst").alias("src"), F.greatest("new_src", "new_dst").alias("dst"), "weight")


@query(" select b.g graph_id, count(*)::bigint walks, round(sum(x.k * y.k) / count(*)::double, 6) mean_product from b join d x on x.g = b.g and x.v = b.u join d y on y.g = b.g and y.v = b.v group by 1")
def edge_products(spark, sf_dir):
    """Mean product of end degrees over directed edges (assortativity's first moment)."""
    n, e = _brand(spark, sf_dir)
    of = G.edge_states(e, G.degree(n, e), "degree")
    return of.groupBy("graph_id").agg((2 * F.count("*")).alias("walks"), _r(F.avg(F.col("a") * F.col("b"))).alias("mean_product"))


@query()
def trained_policies(spark, sf_dir):
    """Validation returns of every learner before and after training on random graphs; reads no table."""
    return T.sweep(spark, [(k, "cover", 0) for k in T.LEARNERS])


_SP = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]"
_ENDS = f"'^{_SP}+|{_SP}+$', '', 'g')"
_BLOCK = f"regexp_replace(regexp_replace(replace(text, chr(173), ''), '[ \\t]+', ' ', 'g'), {_ENDS}"
_HYPHENS = f"regexp_replace(regexp_replace({_BLOCK}, '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g'), '([A-Za-z])-{_SP}*\\n{_SP}*([a-z])', '\\1\\2', 'g')"
_PAGE = f"regexp_replace(regexp_replace({_HYPHENS}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {_ENDS}"


@query(f"select doc_id, length(x)::int n, md5(x) digest from (select doc_id, {_PAGE} x from documents)", view=False)
def dehyphenated_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clean(X.block_text(F.col("text"))).alias("x")).select("doc_id", F.length("x").alias("n"), F.md5("x").alias("digest"))


@query()
def stripped_furniture(spark, sf_dir):
    """Documents less the lines whose form recurs on a hundredth of them, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keys = X.furniture(docs.select(F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("line")), share=0.01)
    return P.strip(docs, keys, ["doc_id"]).select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))
