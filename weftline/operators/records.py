"""Records that cite each other as a checked relation graph.

A record has id, title, venue, year, problem, methods, domain, method, task and cites (target, relation, evidence,
place); a declared relation has from, to, basis, relation and reason. Errors are rows, so that one pass shows all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values.
REQUIRED = ("id", "title", "venue", "year", "problem", "methods")
BASES = ("same", "method", "infer")
RECORD = "id string, title string, venue string, year int, authors string, problem string, methods string, domain array<string>, method array<string>, task array<string>, cites array<struct<target:string,relation:string,evidence:string,where:string>>"
DECLARED = "`from` string, `to` string, basis string, relation string, reason string, bidirectional boolean"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record a file; a file that does not parse ends the read."""
    return spark.read.schema(RECORD).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))


def record_errors(records: DataFrame) -> DataFrame:
    """id, rule: missing fields, no domain, no task, an id used twice."""
    rules = [F.when(_blank(c), F.lit(f"no {c}")) for c in REQUIRED] + [F.when(F.coalesce(F.size("domain"), F.lit(0)) < 1, F.lit("no domain")), F.when(F.col("task").isNull(), F.lit("no task"))]
    missing = records.select("id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    return missing.union(records.groupBy("id").count().where("count > 1").select("id", F.lit("id used twice")))


def cited(records: DataFrame) -> DataFrame:
    """Edges of citations with the first rule that each breaks as ``error``."""
    ids = records.select(F.col("id").alias("to")).distinct().withColumn("_known", F.lit(True))
    c = records.select(F.col("id").alias("from"), F.explode("cites").alias("c")).select("from", F.col("c.target").alias("to"), F.coalesce("c.relation", F.lit("citation")).alias("relation"), F.col("c.evidence").alias("reason"))
    error = F.when(F.col("_known").isNull(), "unknown target").when(_blank("reason"), "no evidence")
    return c.join(ids, "to", "left").select("from", "to", F.lit("explicit").alias("basis"), "relation", "reason", error.alias("error"))


def declared(records: DataFrame, relations: DataFrame) -> DataFrame:
    """Declared edges with the first rule that each breaks."""
    ids = records.select("id").distinct()
    of = relations.join(ids.select(F.col("id").alias("from"), F.lit(True).alias("_a")), "from", "left").join(ids.select(F.col("id").alias("to"), F.lit(True).alias("_b")), "to", "left")
    error = (
        F.when(F.col("_a").isNull(), "unknown start").when(F.col("_b").isNull(), "unknown end").when(F.col("from") == F.col("to"), "loop")
        .when(F.col("basis") == "explicit", "explicit by declaration").when(_blank("reason"), "no reason").when(~F.coalesce(F.col("basis").isin(*BASES), F.lit(False)), "unknown basis")
    )
    return of.select("from", "to", "basis", "relation", "reason", error.alias("error"))


def relations(records: DataFrame, declarations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges, and errors or warnings (from, to, rule).

    A citation goes before a declaration of the same direction, which is left out with a warning; citations given
    twice stay, with a warning; a declaration given twice counts once, with an error.
    """
    every = cited(records).unionByName(declared(records, declarations))
    w = Window.partitionBy("from", "to")
    good = every.where("error is null").withColumn("_cited", F.count(F.when(F.col("basis") == "explicit", 1)).over(w))
    turn = F.row_number().over(w.orderBy(F.when(F.col("basis") == "explicit", 0).otherwise(1), "basis", F.col("relation"), F.col("reason")))
    rule = F.when((F.col("basis") != "explicit") & (F.col("_cited") > 0), "declared beside a citation").when((F.col("basis") != "explicit") & (F.col("_turn") > 1), "declared twice").when(F.col("_turn") > 1, "cited twice")
    judged = good.withColumn("_turn", turn).withColumn("rule", rule)
    edges = judged.where("basis = 'explicit' or rule is null").select("from", "to", "basis", "relation", "reason")
    found = every.where("error is not null").select("from", "to", F.col("error").alias("rule"))
    return edges, found.union(judged.where("rule is not null").select("from", "to", "rule"))


def _tags(records: DataFrame) -> DataFrame:
    tag = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit(c).alias("kind"), x.alias("tag")))
    return records.select("id", F.explode(F.array_distinct(F.concat(*map(tag, ("domain", "method", "task"))))).alias("t")).select("id", "t.*")


def gaps(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of records that share a domain, method or task and have no edge either way. Joined on the tag, not all pairs."""
    t = _tags(records)
    pairs = t.withColumnRenamed("id", "first").join(t.withColumnRenamed("id", "second"), ["kind", "tag"]).where("first < second")
    shared = pairs.groupBy("first", "second").agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "tag"))).alias("shared"))
    linked = edges.select(F.least("from", "to").alias("first"), F.greatest("from", "to").alias("second")).distinct()
    return shared.join(linked, ["first", "second"], "left_anti")


def weak(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges other than citations whose ends share neither a domain nor a method."""
    t = _tags(records).where("kind != 'task'")
    shared = edges.where("basis != 'explicit'").join(t.withColumnRenamed("id", "from"), "from").join(t.withColumnRenamed("id", "to"), ["to", "kind", "tag"], "left_semi")
    return edges.where("basis != 'explicit'").join(shared.select("from", "to").distinct(), ["from", "to"], "left_anti")


def around(edges: DataFrame, record: str) -> DataFrame:
    """Edges at a record, and on which side it is."""
    return edges.where((F.col("from") == record) | (F.col("to") == record)).withColumn("side", F.when(F.col("from") == record, "out").otherwise("in"))


def page(records: DataFrame) -> DataFrame:
    """What a drawn node shows, blanks replaced."""
    lead = F.concat(F.split(F.coalesce("authors", F.lit("")), ",")[0], F.lit(" et al. · "))
    return records.select("id", "title", F.concat(F.when(_blank("authors"), "").otherwise(lead), "venue", F.lit(" "), F.col("year").cast("string")).alias("subtitle"), F.coalesce("domain", F.array().cast("array<string>")).alias("domain"))
