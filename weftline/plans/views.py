"""Graph tables made from relational ones.

``nodes``: graph_id, node_id and attributes. ``edges``: graph_id, src < dst, weight; each undirected edge once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("graph_id"), F.col("p_partkey").alias("node_id"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def brand_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand that share an order; weight is the number of orders. One join on (order, brand)."""
    bought = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    of = bought.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.col("p_brand").alias("graph_id")), "p")
    pairs = of.withColumnRenamed("p", "src").join(of.withColumnRenamed("p", "dst"), ["o", "graph_id"]).where("src < dst")
    return pairs.groupBy("graph_id", "src", "dst").agg(F.count("*").alias("weight"))


def both(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, from one scan."""
    way = F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v"))))
    return edges.select("graph_id", "weight", way.alias("x")).select("graph_id", "x.u", "x.v", "weight")


def signed(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", F.when((F.col("src") * 31 + F.col("dst")) % 2 == 0, 1).otherwise(-1))


def residual(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes not removed, and edges whose ends both remain."""
    gone = removed.select("graph_id", "node_id")
    left = nodes.join(gone, ["graph_id", "node_id"], "left_anti")
    kept = edges
    for end in ("src", "dst"):
        kept = kept.join(gone.withColumnRenamed("node_id", end), ["graph_id", end], "left_anti")
    return left, kept
