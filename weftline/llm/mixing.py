"""Mixing sources to target weights, in DataFrame functions only.

Sizes are words of the whole text. Each source's target is its share by weight
of ``share`` times all sizes, but at most ``most`` times its own size; what a
source can't take is reshared by weight until none is above. The fixed point of
that resharing is found at once: sources sorted by cap over weight are capped up
to the first whose even share fits. Every document is emitted floor(rate) times,
and once more if a hash of its id falls under the fraction.

Defined results: a null or empty text has size 0 and is taken 0 words; a null
source is a source of its own, the last; a null id is hashed as 'null'; repeated
rows are emitted alike; an empty table gives no rows; a column of ``docs`` that
has the name of an added one gives way to it, any other keeps its name and values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch
from weftline.llm.textkit import unused, without

#: Most sources whose targets are broadcast; beyond that, rows meet them by shuffle.
MOST_BROADCAST = 200_000
WORD = "[^\\x20\\x09-\\x0D]+"


def words_in(text: Column) -> Column:
    """Number of words: runs of anything but white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of the key's md5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target; one row per source. The windows below run over this small table."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights))).withColumn("cap", most * F.col("source_size"))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    spread = (
        ranked.withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", (share * F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"]
    return spread.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """Every row of ``docs`` with mix_size, mix_source_size, mix_target and mix_copies."""
    docs = without(docs, "mix_size", "mix_source_size", "mix_target", "mix_copies")
    own = unused(docs, "source")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    sized = docs.select(F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"))
    plan = Scratch(docs.sparkSession, "mix").write("targets", targets(sized, weights, share, most))
    plan = plan.select(F.col("source").alias(own), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    if plan.count() <= MOST_BROADCAST:
        plan = F.broadcast(plan)
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + (uniform(F.concat(F.lit(seed + ":"), key)) < rate - whole).cast("long")).cast("long")
    # sources are few: no text moves; sized before the join, so that beyond the bound a caller that needs no texts moves none
    joined = docs.withColumn("mix_size", words_in(F.col(text_col))).join(plan, F.col(source_col).eqNullSafe(F.col(own)), "left")
    return joined.withColumn("mix_copies", copies).drop(own)


def emitted(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with copy from 1."""
    docs = without(docs, "copy")
    mixed = mix(docs, **how).where("mix_copies > 0")
    return mixed.select(*without(docs, "mix_size", "mix_source_size", "mix_target", "mix_copies").columns, F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies")).alias("copy"))
