"""Page layout, scalar functions, small aggregates and regular graphs over the tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import layout as P
from weftline.operators import text as T
from weftline.plans.graph_queries import query
from weftline.plans.views import table
from weftline.sources import generators as G

#: Line items as text blocks: four orders a page of 600 x 800.
_BLOCKS = """with bl as (select 1::bigint doc, l_orderkey // 4 page, case when l_partkey % 2 = 0 then 10 else 310 end + l_quantity / 5::double x0, l_linenumber * 100::double - 60 + l_suppkey % 89 y0,
  case when l_partkey % 2 = 0 then 10 else 310 end + l_quantity / 5::double + case when l_suppkey % 17 = 0 then 350 else 200 end x1, l_linenumber * 100::double - 60 + l_suppkey % 89 + 12 y1,
  l_returnflag || l_linestatus || ' ' || l_partkey as text from lineitem)"""
_GUTTER = _BLOCKS + """,
pn as (select page, count(*) n from bl group by 1 having count(*) >= 6),
cand as (select page, n, k, 600 * (0.28::double + (0.72::double - 0.28::double) * k / 240) x from pn, range(1, 240) t(k)),
sides as (select c.page, n, k, x, count(*) filter (x1 <= x) l, count(*) filter (x0 >= x) r from cand c join bl on bl.page = c.page group by all),
gut as (select page, arg_max(x, (least(l, r) - 3 * (n - l - r)) * 1000 - k) gutter from sides where l >= 4 and r >= 4 and n - l - r <= greatest(2, floor(n * 0.15::double)) group by 1)"""


def blocks(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    x0 = F.when(F.col("l_partkey") % 2 == 0, 10).otherwise(310) + F.col("l_quantity") / 5
    y0 = F.col("l_linenumber") * F.lit(100.0) - 60 + F.col("l_suppkey") % 89
    text = F.concat("l_returnflag", "l_linestatus", F.lit(" "), F.col("l_partkey").cast("string"))
    return l.select(
        F.lit(1).cast("long").alias("doc"), F.floor(F.col("l_orderkey") / 4).alias("page"), x0.alias("x0"), y0.alias("y0"),
        (x0 + F.when(F.col("l_suppkey") % 17 == 0, 350).otherwise(200)).alias("x1"), (y0 + 12).alias("y1"), text.alias("text"),
    )


def pages(found: DataFrame) -> DataFrame:
    return found.select(*P.PAGE).distinct().select(*P.PAGE, F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))


@query(_GUTTER + " select page, round(gutter, 6) gutter from gut", view=False)
def page_gutters(spark, sf_dir):
    """Where pages of two columns are parted."""
    b = blocks(spark, sf_dir)
    return P.gutters(b, pages(b)).select("page", F.round("gutter", 6).alias("gutter"))


@query(
    _GUTTER + """,
w as (select bl.*, gutter, gutter is not null and x0 < gutter and x1 > gutter wide from bl left join gut on gut.page = bl.page),
o as (select w.page, w.text, w.x0, w.y0, w.y1, case when gutter is null then 0 else (select count(*) from w z where z.page = w.page and z.wide and z.y0 < w.y0 - 2) end band,
  case when gutter is null or wide then 0 else (x0 >= gutter)::int end col from w)
select page, md5(string_agg(text, '|' order by band, col, round(y0, 1), x0, y1, text)) digest from o group by 1""",
    view=False,
)
def reading_order(spark, sf_dir):
    """Blocks of each page in reading order, as a digest."""
    b = blocks(spark, sf_dir)
    of = P.ordered(b, pages(b)).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("b"))
    return of.select("page", F.md5(F.array_join("b.text", "|")).alias("digest"))


@query(_BLOCKS + " select page, count(*) n, min(text) as first_text from bl where y0 / 800 < 0.085::double or y1 / 800 > 0.915::double group by 1", view=False)
def margin_lines(spark, sf_dir):
    """Lines in the top or bottom margin."""
    b = blocks(spark, sf_dir)
    return P.edge_lines(b, pages(b)).groupBy("page").agg(F.count("*").alias("n"), F.min("text").alias("first_text"))


@query("with l as (select l_orderkey // 4 page, l_quantity / 4::double size, l_linestatus = 'F' bold, l_returnflag || l_partkey as text from lineitem) select page, count(*) n, max(round(size, 1)) largest, count(*) filter (bold)::bigint bolds from l where length(text) <= 90 and (size >= 10.5 or (bold and size >= 8.5 and length(text) < 60)) group by 1", view=False)
def heading_lines(spark, sf_dir):
    """Headings by size and weight."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit(1).alias("doc"), F.floor(F.col("l_orderkey") / 4).alias("page"), (F.col("l_quantity") / 4).alias("size"), (F.col("l_linestatus") == "F").alias("bold"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text")
    )
    return P.outline(rows).groupBy("page").agg(F.count("*").alias("n"), F.max("size").alias("largest"), F.sum(F.col("bold").cast("long")).alias("bolds"))


_MARK = "'**' || p_brand || '** & `' || p_type || '` <' || p_name || '>'"


@query(
    f"select p_partkey, p_size % 7 = 0 and regexp_full_match(p_size::varchar, '[0-9]+') digits, regexp_replace(regexp_replace(replace(replace(replace({_MARK}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
    "'\\*\\*([^\n\r]+?)\\*\\*', '<b>\\1</b>', 'g'), '`([^\n\r]+?)`', '<code>\\1</code>', 'g') html from part",
    view=False,
)
def marked_up_names(spark, sf_dir):
    """Inline marks as HTML, and a test for digits alone."""
    text = F.concat(F.lit("**"), "p_brand", F.lit("** & `"), "p_type", F.lit("` <"), "p_name", F.lit(">"))
    digits = T.is_number(F.when(F.col("p_size") % 7 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.lit("x"), F.col("p_size").cast("string"))))
    return table(spark, sf_dir, "part").select("p_partkey", digits.alias("digits"), T.marked_up(text).alias("html"))


@query(
    "select p_partkey, least(greatest(p_retailprice, 950), 1200)::double clamped, round(1 / (1 + exp(-(p_size / 10::double))), 6) sigmoid, case when p_size > 25 then 1 else -1 end spin, p_partkey * 3 + p_size % 3 flat, "
    "p_partkey as node, (p_size % 3)::bigint as label, case when p_size % 5 = 0 then 0.0 else p_size::double end finite, case when abs(p_size - 10) <= abs(p_size - 30) then 'low' else 'mid' end nearest from part",
    view=False,
)
def scalar_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    flat = S.flat_action(F.col("p_partkey"), F.col("p_size") % 3, 3)
    node, label = S.split_action(flat, 3)
    odd = F.when(F.col("p_size") % 10 == 0, F.lit(float("nan"))).when(F.col("p_size") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("p_size").cast("double"))
    return p.select(
        "p_partkey", S.clamp(F.col("p_retailprice"), 950.0, 1200.0).alias("clamped"), F.round(S.sigmoid(F.col("p_size") / 10), 6).alias("sigmoid"), S.spin(F.col("p_size") > 25).alias("spin"), flat.alias("flat"),
        node.cast("long").alias("node"), label.cast("long").alias("label"), S.finite(odd).alias("finite"), S.nearest(F.col("p_size"), {"low": 10.0, "mid": 30.0}).alias("nearest"),
    )


@query("select vec_id, round(sqrt(list_sum([x::double * x::double for x in embedding])), 5) norm, round(list_sum([x::double * x::double for x in embedding]), 4) dot from embeddings where embedding is not null and len(embedding) > 0", view=False)
def vector_norms(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").where("size(embedding) > 0").select("vec_id", F.round(S.l2_norm(x), 5).alias("norm"), F.round(S.dot(x, x), 4).alias("dot"))


@query("select p_brand brand, round(median(p_retailprice), 4) middle, avg((p_size > 5)::int) >= 0.9 mostly, round(coalesce(sum(p_retailprice) filter (p_size > 40), 0) / greatest(count(*) filter (p_size > 40), 1), 4) masked_mean from part group by 1", view=False)
def masked_measures(spark, sf_dir):
    """Averaged median, whether nine tenths hold, and a mean under a mask that is 0 where the mask is empty."""
    big = F.col("p_size") > 40
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(
        F.round(F.percentile("p_retailprice", 0.5), 4).alias("middle"), S.mostly(F.col("p_size") > 5).alias("mostly"), F.round(S.masked_mean(F.col("p_retailprice"), big), 4).alias("masked_mean"),
    )


@query("with o as (select o_orderpriority kind, o_totalprice x, row_number() over (partition by o_orderpriority order by o_orderkey) - 1 i from orders) select kind, arg_min(i, (x, i))::bigint as best, arg_min(i, (x, i))::bigint * 300 as iteration, min(x) lowest from o where i >= 33 group by 1", view=False)
def best_checkpoint(spark, sf_dir):
    """The step of the lowest score from the 34th on, the first of equals, and its iteration."""
    at = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")) - 1
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("x"), at.cast("long").alias("i"))
    return o.where("i >= 33").groupBy("kind").agg(F.min_by("i", F.struct("x", "i")).alias("best"), F.min("x").alias("lowest")).select("kind", "best", (F.col("best") * 300).alias("iteration"), "lowest")


@query("with s as (select p_size::bigint g, count(*) % 9 + 5 n from part group by 1) select g graph_id, n * (n - 1) // 2 as complete, case when n = 5 then 10 else 2 * n end as ring, 2 * 6 * 6 as lattice, n as nodes from s", view=False)
def regular_graphs(spark, sf_dir):
    """Edges of complete graphs, of rings of four neighbours and of periodic grids, made for every part size."""
    sized = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("graph_id")).agg((F.count("*") % 9 + 5).alias("n"))
    count = lambda e, name: e.groupBy("graph_id").agg(F.count("*").alias(name))
    grid = G.lattice(spark, 6).count()
    out = count(G.complete(sized), "complete").join(count(G.small_world(sized, 4, 0.0), "ring"), "graph_id").join(count(G.nodes(sized), "nodes"), "graph_id")
    return out.withColumn("lattice", F.lit(grid))
