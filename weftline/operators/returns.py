"""Learning targets as tables: advantages, prioritised draws, value distributions, soft values, ranks of methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gae(rows: DataFrame, key: str, order: list[str], reward: str, value: str, gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """``advantage`` and ``target`` by the reverse scan adv = delta + gamma * lam * adv; the value after the last row is 0.

    One episode is one array: an episode has to fit in a task, as its scan is sequential.
    """
    step = F.struct(*order, F.col(reward).cast("double").alias("_r"), F.col(value).cast("double").alias("_v"), F.struct(*[c for c in rows.columns if c != key]).alias("_row"))
    of = rows.groupBy(key).agg(F.reverse(F.sort_array(F.collect_list(step))).alias("steps"))

    def back(acc: Column, x: Column) -> Column:
        delta = x["_r"] + gamma * acc["next"] - x["_v"]
        adv = delta + gamma * lam * acc["adv"]
        return F.struct(x["_v"].alias("next"), adv.alias("adv"), F.concat(acc["out"], F.array(adv)).alias("out"))

    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("adv"), F.array().cast("array<double>").alias("out"))
    scanned = of.select(key, F.arrays_zip("steps", F.aggregate("steps", start, back)["out"].alias("a")).alias("z"))
    flat = scanned.select(key, F.explode("z").alias("z")).select(key, "z.steps._row.*", F.col("z.a").alias("advantage"), F.col("z.steps._v").alias("_v"))
    return flat.withColumn("target", F.col("advantage") + F.col("_v")).drop("_v")


def priorities(error: Column, power: float = 0.6, floor: float = 1e-7, limit: float = 1.0) -> Column:
    return F.least(F.abs(error) + floor, F.lit(limit)) ** power


def prefix_sums(rows: DataFrame, order: str, value: str, buckets: int = 64) -> DataFrame:
    """``lo`` and ``hi``, the running sum before and with each row; sums of buckets first, so that no task sorts all rows.

    ``order`` is a number that rows are unique by; buckets are its ranges.
    """
    ends = rows.agg(F.min(order).alias("_a"), F.max(order).alias("_b"))
    cut = F.least(F.floor((F.col(order) - F.col("_a")) * buckets / (F.col("_b") - F.col("_a") + 1)), F.lit(buckets - 1))
    of = rows.crossJoin(F.broadcast(ends)).withColumn("_k", cut).drop("_a", "_b")  # one row of bounds
    inner = F.sum(value).over(Window.partitionBy("_k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    whole = of.groupBy("_k").agg(F.sum(value).alias("_s"))  # at most ``buckets`` rows
    before = whole.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("_k", "_before")
    return of.withColumn("_in", inner).join(F.broadcast(before), "_k").withColumn("hi", F.col("_before") + F.col("_in")).withColumn("lo", F.col("hi") - F.col(value)).drop("_k", "_in", "_before")


def prioritised_draw(rows: DataFrame, order: str, priority: str, draws: int, beta: float = 0.4, at: Column | None = None) -> DataFrame:
    """draw, the row that holds it and its importance weight (p / least p) ** -beta; one draw in each of equal strata of the total.

    ``at`` places a draw in its stratum, 0 to 1 (default: the middle). Each row finds the strata that it covers, so no range join.
    """
    sums = prefix_sums(rows, order, priority)
    total = rows.agg(F.sum(priority).alias("_t"), F.min(priority).alias("_least"))
    point = F.lit(0.5) if at is None else at
    seg = F.col("_t") / draws
    first, last = F.greatest(F.floor(F.col("lo") / seg), F.lit(0)), F.least(F.floor(F.col("hi") / seg), F.lit(draws - 1))
    spread = sums.crossJoin(F.broadcast(total)).withColumn("draw", F.explode(F.sequence(first, F.greatest(first, last))))
    v = (F.col("draw") + point) * seg
    return spread.where((v > F.col("lo")) & (v <= F.col("hi"))).withColumn("is_weight", (F.col(priority) / F.col("_least")) ** -beta).drop("_t", "_least")


def projected_distribution(rows: DataFrame, key: list[str], atom: str, p: str, reward: str, discount: str, atoms: int = 51, low: float = -10.0, high: float = 10.0) -> DataFrame:
    """Mass of reward + discount * z on the atoms z, shared linearly between the two nearest: key, atom, p."""
    gap = (high - low) / (atoms - 1)
    z = F.lit(low) + F.col(atom) * gap
    at = (F.least(F.greatest(F.col(reward) + F.col(discount) * z, F.lit(low)), F.lit(high)) - low) / gap
    near = rows.withColumn("_at", at).withColumn("_lo", F.least(F.floor("_at"), F.lit(atoms - 2)))
    part = F.explode(F.array(F.struct(F.col("_lo").alias("atom"), (F.col(p) * (F.col("_lo") + 1 - F.col("_at"))).alias("p")), F.struct((F.col("_lo") + 1).alias("atom"), (F.col(p) * (F.col("_at") - F.col("_lo"))).alias("p"))))
    return near.select(*key, part.alias("_m")).groupBy(*key, F.col("_m.atom").alias("atom")).agg(F.sum("_m.p").alias("p"))


def soft_value(scored: DataFrame, key: str, score: str, tau: float = 0.03, low: float = -1.0) -> DataFrame:
    """``log_policy`` (of softmax(score / tau), times tau, cut at ``low``) and the soft value of the key."""
    top = scored.groupBy(key).agg(F.max(score).alias("_top"))
    e = scored.join(top, key)
    mass = e.groupBy(key).agg(F.sum(F.exp((F.col(score) - F.col("_top")) / tau)).alias("_z"))
    out = e.join(mass, key).withColumn("soft_value", F.col("_top") + tau * F.log("_z"))
    return out.withColumn("log_policy", F.greatest(F.col(score) - F.col("soft_value"), F.lit(low))).drop("_top", "_z")


def group_advantage(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Return less the mean return of the group's copies."""
    return rows.join(rows.groupBy(key).agg(F.avg(value).alias("_m")), key).withColumn("advantage", F.col(value) - F.col("_m")).drop("_m")


def ranked_methods(results: DataFrame, method: str, value: str, maximise: bool) -> DataFrame:
    """method, graphs, mean, deviation, rank, gap (percent short of the best mean, over its magnitude)."""
    of = results.groupBy(method).agg(F.count(value).alias("graphs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))
    order = F.col("mean").desc_nulls_last() if maximise else F.col("mean").asc_nulls_last()
    every = Window.orderBy(order)  # one row a method
    best = F.first("mean").over(every)
    short = (best - F.col("mean")) if maximise else (F.col("mean") - best)
    gap = F.when(best != 0, 100 * short / F.abs(best)).when(short == 0, 0.0).otherwise(F.lit(float("inf")))
    return of.withColumn("rank", F.rank().over(every)).withColumn("gap", gap)


def best_of(decoded: DataFrame, key: str, value: str, maximise: bool = True) -> DataFrame:
    """The best of the decoded solutions of each graph."""
    return decoded.groupBy(key).agg((F.max if maximise else F.min)(value).alias(value), F.count("*").alias("tried"))


def last_rows(rows: DataFrame, order: str, capacity: int) -> DataFrame:
    """A ring buffer's content: the ``capacity`` rows of highest ``order``, by a top-k, not a full sort."""
    return rows.orderBy(F.col(order).desc()).limit(capacity)


def t_statistic(value: str) -> Column:
    """Mean over its standard error, as an aggregate."""
    return F.avg(value) / (F.stddev_samp(value) / F.sqrt(F.count(value)))


def prefix_state(rows: DataFrame, key: str, order: list[str], action: str) -> DataFrame:
    """``selected``: the actions of the earlier rows of the episode."""
    return rows.withColumn("selected", F.collect_list(action).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))


def weighted_sum(terms: list[tuple[float, Column]]) -> Column:
    return reduce(lambda a, b: a + b, (w * c for w, c in terms))
