"""Reductions of rows by a bucket, dense over all buckets, and choices among the rows of one graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.generators import draw

MASKED = -1e9


def scatter(rows: DataFrame, buckets: DataFrame, index: str, value: str, how: str, fill: float = 0.0) -> DataFrame:
    """``value`` by ``index`` for every row of ``buckets``: sum, mean, max, min; empty buckets hold ``fill``."""
    f = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how]
    return buckets.select(index).join(rows.groupBy(index).agg(f(value).alias(value)), index, "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def log_sum_exp(rows: DataFrame, index: str, score: str) -> DataFrame:
    """Stable logarithm of summed exponentials by bucket, as ``lse``."""
    top = rows.join(rows.groupBy(index).agg(F.max(score).alias("_top")), index)
    return top.groupBy(index).agg((F.first("_top") + F.log(F.greatest(F.sum(F.exp(F.col(score) - F.col("_top"))), F.lit(1e-16)))).alias("lse"))


def log_softmax(rows: DataFrame, index: str, score: str) -> DataFrame:
    return rows.join(log_sum_exp(rows, index, score), index).withColumn("log_p", F.col(score) - F.col("lse")).drop("lse")


def masked(score: str, legal: Column) -> Column:
    return F.when(legal, F.col(score)).otherwise(F.lit(MASKED))


def sampled(rows: DataFrame, index: str, node: str, score: str, seed: int = 0) -> DataFrame:
    """One row a bucket, drawn by softmax of the score: the largest score plus Gumbel noise hashed from (bucket, node)."""
    u = F.greatest(draw(seed, index, node), F.lit(1e-12))
    noisy = rows.withColumn("_s", F.col(score) - F.log(-F.log(u)))
    return noisy.groupBy(index).agg(F.max_by(node, F.struct("_s", -F.col(node))).alias(node))


def chosen_log_p(rows: DataFrame, index: str, node: str, score: str, actions: DataFrame) -> DataFrame:
    """log probability of each bucket's action; action -1 has 0."""
    of = log_softmax(rows, index, score).select(index, F.col(node).alias("action"), "log_p")
    return actions.join(of, [index, "action"], "left").withColumn("log_p", F.when(F.col("action") == -1, 0.0).otherwise(F.col("log_p")))


def permuted(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """graph_id, node_id, new_id: a hashed relabelling of every graph."""
    order = Window.partitionBy("graph_id").orderBy(draw(seed, "graph_id", "node_id"), "node_id")
    return nodes.select("graph_id", "node_id", (F.row_number().over(order) - 1).alias("new_id"))


def repeated(rows: DataFrame, copies: int) -> DataFrame:
    """``copies`` of each graph, told apart by ``copy``."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
