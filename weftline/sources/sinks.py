"""Results as files. Each sink is one write, committed as a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graphs(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Node and edge tables with all columns, as Parquet by graph."""
    nodes.write.mode(mode).parquet(f"{path}/nodes")
    edges.write.mode(mode).parquet(f"{path}/edges")


def solution(order: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Node ids by step, one a line, in a folder per graph; files of a folder follow each other by name."""
    order.repartitionByRange("graph_id", "step").sortWithinPartitions("graph_id", "step").select("graph_id", F.col("node_id").cast("string").alias("value")).write.mode(mode).partitionBy("graph_id").text(path)


def curve(points: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The share of the largest component by step, eight decimals a line."""
    points.repartitionByRange("graph_id", "step").sortWithinPartitions("graph_id", "step").select("graph_id", F.format_string("%.8f", F.col("share").cast("double")).alias("value")).write.mode(mode).partitionBy("graph_id").text(path)


def scores(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    results.write.mode(mode).option("header", True).csv(path)


def metrics(rows: DataFrame, path: str) -> None:
    """Appends JSON lines."""
    rows.write.mode("append").json(path)


def spread(value: str):
    """``mean±deviation`` as an aggregate, two decimals."""
    return F.concat(F.format_string("%.2f", F.avg(value)), F.lit("±"), F.format_string("%.2f", F.stddev_pop(value)))


def gml(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One GML text a graph, with node weights; a graph has to fit in a task, as the format is one file."""
    n = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_id", F.col("weight").cast("double").alias("w")))).alias("n"))
    e = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("e"))
    node = F.transform("n", lambda x: F.format_string("  node [\n    id %d\n    label \"%d\"\n    weight %s\n  ]", x["node_id"], x["node_id"], x["w"].cast("string")))
    edge = F.transform(F.coalesce("e", F.array()), lambda x: F.format_string("  edge [\n    source %d\n    target %d\n  ]", x["src"], x["dst"]))
    text = F.concat(F.lit("graph [\n"), F.array_join(F.concat(node, edge), "\n"), F.lit("\n]"))
    n.join(e, "graph_id", "left").select("graph_id", text.alias("value")).write.mode(mode).partitionBy("graph_id").text(path)


def relation_page(records: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """NODES and EDGES as JSON lines, for a drawing."""
    one = records.select(F.lit("nodes").alias("part"), F.to_json(F.struct(*records.columns)).alias("value"))
    two = edges.select(F.lit("edges").alias("part"), F.to_json(F.struct(*edges.columns)).alias("value"))
    one.unionByName(two).write.mode(mode).partitionBy("part").text(path)


def extracted(made: DataFrame, whole: DataFrame, described: DataFrame, headings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """What extraction gives of documents, a folder each: whole text, JSON of figures, headings and the text of every page."""
    whole.select("doc", F.col("text").alias("value")).write.mode(mode).partitionBy("doc").text(f"{path}/txt")
    described.select("doc", F.col("json").alias("value")).write.mode(mode).partitionBy("doc").text(f"{path}/meta")
    line = F.format_string("p%3d  %5s  %s  %s", F.col("page"), F.col("size").cast("string"), F.when(F.col("bold"), "B").otherwise(" "), F.col("text"))
    headings.repartitionByRange("doc", "page").sortWithinPartitions("doc", "page").select("doc", line.alias("value")).write.mode(mode).partitionBy("doc").text(f"{path}/outline")
    made.select("doc", "page", F.col("text").alias("value")).write.mode(mode).partitionBy("doc", "page").text(f"{path}/pages")
