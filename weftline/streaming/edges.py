"""Graphs from streams of edges: windowed degrees, and a component table kept up to date batch by batch.

Component tables are written under a path that all workers share, one version a batch; a batch that is run
again after a failure writes the same version again, so a restart neither loses nor doubles edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_degree(edges: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Edges at each node by window; later rows than ``late`` are left out."""
    ends = edges.withWatermark(ts, late).select(ts, F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.groupBy(F.window(ts, window).alias("w"), "node_id").agg(F.count("*").alias("degree")).select(F.col("w.start").alias("start"), "node_id", "degree")


def moving_metrics(rows: DataFrame, ts: str, key: str, value: str, window: str = "1 hour", slide: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """Mean and count of a metric over sliding windows."""
    of = rows.withWatermark(ts, late).groupBy(F.window(ts, window, slide).alias("w"), key).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return of.select(F.col("w.start").alias("start"), key, "mean", "n")


def _joined(labels: DataFrame, edges: DataFrame, rounds: int, write: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """Labels of old and new nodes after ``edges``: the smallest label spreads over the graph of touched labels."""
    ends = edges.select("src", "dst").where("src is not null and dst is not null")
    fresh = ends.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().join(labels, "node_id", "left_anti")
    every = write("every", labels.unionByName(fresh.withColumn("label", F.col("node_id"))))
    of = every.select("node_id", "label")
    links = ends.join(of.toDF("src", "a"), "src").join(of.toDF("dst", "b"), "dst").where("a != b").select("a", "b").distinct()
    links = write("links", links.union(links.select("b", "a")).distinct())
    best = write("best0", links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    for k in range(1, rounds + 1):
        seen = links.join(best.toDF("b", "n"), "b").groupBy("a").agg(F.min("n").alias("n"))
        step = best.join(seen, "a", "left").select("a", F.least("m", "n").alias("m"))
        # a label's own best may have got better too: follow it once, so paths halve
        step = step.join(step.toDF("m", "far"), "m", "left").select("a", F.least("m", F.coalesce("far", "m")).alias("m"))
        new = write(f"best{k}", step)
        moved = new.join(best.withColumnRenamed("m", "old"), "a").where("m < old").limit(1).count()
        best = new
        if not moved:
            break
    else:
        raise RuntimeError(f"labels still move after {rounds} rounds")
    return every.join(best.toDF("label", "m"), "label", "left").select("node_id", F.coalesce("m", "label").alias("label"))


def maintain_components(stream: DataFrame, path: str, checkpoint: str, rounds: int = 60, **trigger):
    """A running query that keeps ``path/v<batch>`` (node_id, label: the smallest node) for all edges so far."""

    def batch(edges: DataFrame, number: int) -> None:
        spark = edges.sparkSession

        def write(name: str, table: DataFrame) -> DataFrame:
            table.write.mode("overwrite").parquet(f"{path}/work/{name}")
            return spark.read.parquet(f"{path}/work/{name}")

        old = version(spark, path, number - 1) if number else spark.createDataFrame([], "node_id long, label long")
        _joined(old, edges, rounds, write).write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def version(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v{number}")
