"""Returns and other windows over ordered rows of one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nstep(rows: DataFrame, key: str, order: list[str], reward: str, n: int, gamma: float) -> DataFrame:
    """``nstep_return`` over the next n rows, discounted, and ``terminal`` where fewer follow."""
    w = Window.partitionBy(key).orderBy(*order)
    total: Column = F.lit(0.0)
    for k in range(n):
        total = total + F.coalesce(F.lead(reward, k).over(w), F.lit(0.0)) * gamma**k
    return rows.withColumn("nstep_return", total).withColumn("terminal", F.lead(reward, n).over(w).isNull())


def running_best(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return rows.withColumn("best", F.max(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def moving_average(rows: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    return rows.withColumn("average", F.avg(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(1 - n, 0)))


def suffix_difference(rows: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """Sum of this and the n - 1 rows that follow: the suffix sum here less that n rows on."""
    return rows.withColumn("difference", F.sum(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(0, n - 1)))


def standardise(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(x - mean) / sqrt(population variance + 1e-6), moments from one partial aggregate."""
    of = rows.groupBy(key).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    return rows.join(of, key).withColumn("z", (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + 1e-6)).drop("_m", "_v")
