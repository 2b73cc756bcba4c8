"""Registered encoders: seeded weights over brand graphs with size, price and degree as features."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import encoders as E
from weftline.operators import graph as G
from weftline.plans.graph_queries import QUERIES, _brand
from weftline.plans.more_queries import _incidence

_ONE_NAME = {f: k for k, f in reversed(list(E.ENCODERS.items()))}


def _features(spark, sf_dir):
    n, e = _brand(spark, sf_dir)
    x = F.array((F.col("size") / 50).alias("a"), F.col("price") / 2000, F.log1p("degree"))
    own = n.join(G.degree(n, e).select(*G.KEY, "degree"), G.KEY)
    return own.select(*G.KEY, (F.col("node_id") % 3).alias("kind"), x.alias("x")), e.withColumn("kind", F.col("weight") % 2).withColumn("weight", F.col("weight").cast("double"))


def _put(kind: str) -> None:
    def run(spark, sf_dir):
        of = _incidence(spark, sf_dir) if kind in ("hgnn", "hypergcn", "hnhn") else None
        return E.encode(*_features(spark, sf_dir), kind, incidence=of)

    run.__name__ = f"encode_{kind}"
    QUERIES[run.__name__] = run


for _kind in _ONE_NAME.values():
    _put(_kind)
