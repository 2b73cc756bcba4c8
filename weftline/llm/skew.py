"""Joins by keys of which a few may hold a large part of all rows.

A key of at least ``hot_size`` rows, a thousandth of all of them, is joined by
broadcast: there are a thousand such keys at most, at any size. The others meet
by shuffle, none of them with more than a thousandth of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 1000


def hot_size(total: int) -> int:
    """Rows from which a key is hot among ``total``."""
    return max(LEAST, total // 1000)


def hot_join(rows: DataFrame, table: DataFrame, by: list[str], total: int, hot: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which holds each key once; inner or left. ``hot``: the keys of at least ``hot_size(total)`` of the ``total`` rows, counted here where not given."""
    if total < LEAST:
        return rows.join(table, by, how)
    if hot is None:
        hot = rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= hot_size(total)).select(*by)
    few = table.join(F.broadcast(hot), by, "left_semi")
    return rows.join(F.broadcast(few), by).unionByName(rows.join(F.broadcast(hot), by, "left_anti").join(table, by, how))
