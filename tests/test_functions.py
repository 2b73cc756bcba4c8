from pyspark.sql import functions as F

from weftline.functions import scalars as S


def test_scalars(spark):
    x = spark.createDataFrame([(1.7, [3.0, 4.0], 7), (float("nan"), [1.0, 0.0], 3), (None, [0.0, 2.0], 0), (float("inf"), [2.0, 1.0], 1)], "x double, v array<double>, a long")
    got = x.select(
        S.clamp(F.col("x"), 0, 1).alias("c"), S.finite(F.col("x")).alias("f"), S.l2_norm(F.col("v")).alias("n"), S.dot(F.col("v"), F.col("v")).alias("d"),
        S.nearest(F.lit(1.5), {"a": 1, "b": 2, "c": 9}).alias("near"), S.median_low(F.array(*map(F.lit, (4, 1, 3, 2)))).alias("m"), S.spin(F.col("a") > 2).alias("s"), S.sigmoid(F.lit(0.0)).alias("g"),
        *[c.alias(k) for c, k in zip(S.split_action(F.col("a"), 3), ("node", "label"), strict=True)], S.flat_action(F.lit(2), F.lit(1), 3).alias("flat"),
    ).collect()
    assert [r.f for r in got] == [1.7, 0, 0, 0] and got[0].c == 1 and [r.n for r in got][:2] == [5, 1] and got[0].d == 25
    assert {(r.near, r.m, r.g, r.flat) for r in got} == {("a", 2, 0.5, 7)} and [r.s for r in got] == [1, 1, -1, -1]
    assert [(r.node, r.label) for r in got] == [(2, 1), (1, 0), (0, 0), (0, 1)]
