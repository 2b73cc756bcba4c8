"""Line deduplication by distinct-site spread.

A line is keyed by a hash of its words, lower-cased. A HyperLogLog sketch of its
sites per key, merged by the aggregation, estimates on how many sites it occurs. A
second sketch counts the different texts it occurs in, as a document copied to many
sites is one text. Keys for which either estimate lies within ``band`` of the
threshold are counted exactly. Lines on at least ``min_sites`` sites, in as many
different texts, are boilerplate. Their first occurrence, by smallest id, stays;
every other is removed.

Defined results: null texts stay null; empty lines are never boilerplate; a null
site counts as a site of its own; rows with a null id keep all lines; repeated
rows count as occurrences, and lose the same lines; a document none of whose lines
is left has an empty text; a column named line_n_removed gives way to the added
one, any other keeps its name and values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch
from weftline.llm.textkit import unused, without


def line_key(line: Column) -> Column:
    """64-bit hash of the line's words in lower case; null for a line without words."""
    flat = F.trim(F.regexp_replace(F.lower(line), "[\\x20\\x09-\\x0D]+", " "))
    return F.when(flat != "", F.xxhash64(flat))


def line_keys(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), line_key)


def _rows(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """doc_id, site, body (a hash of the text's line keys) and key of every line that has words."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(site_col).cast("string"), F.lit("\0")).alias("site"), line_keys(F.col(text_col)).alias("keys"))
    return keyed.select("doc_id", "site", F.xxhash64("keys").alias("body"), F.explode("keys").alias("key")).where("key is not null")


def boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", **how) -> DataFrame:
    """key, sites, occurrences and first_id (the smallest id that has it) of boilerplate lines."""
    scratch = Scratch(docs.sparkSession, "lines")
    return _spread(scratch.write("lines", _rows(docs, id_col, text_col, site_col)), scratch, **how)


def _matched(rows: DataFrame, keys: DataFrame, often: int) -> DataFrame:
    """``rows`` joined with ``keys``; no key brings more than ``often`` rows to one task.

    Keys of more occurrences are joined by broadcast: with ``often`` a thousandth of all rows, there are fewer than a thousand.
    """
    hot = F.broadcast(keys.where(F.col("occurrences") > often))
    calm = rows.join(hot.select("key"), "key", "left_anti")
    return rows.join(hot, "key").unionByName(calm.join(keys.where(F.col("occurrences") <= often), "key"))


def _spread(lines: DataFrame, scratch: Scratch, min_sites: int = 5, band: float = 0.25, precision: int = 12) -> DataFrame:
    estimate = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(precision)))
    spread = lines.groupBy("key").agg(estimate("site").alias("site_estimate"), estimate("body").alias("body_estimate"), F.count("*").alias("occurrences"), F.min("doc_id").alias("first_id"))
    least = F.least("site_estimate", "body_estimate")
    # few of all keys; written, as exact counts and removals read them several times
    wide = scratch.write("wide", spread.where(least >= min_sites * (1 - band)))
    near = wide.where(least <= min_sites * (1 + band)).select("key", "occurrences")
    seen = _matched(lines.select("key", "site", "body"), near, _often(lines))
    exact = lambda c: seen.select("key", c).distinct().groupBy("key").agg(F.count("*").alias(f"{c}_exact"))
    counted = wide.join(exact("site"), "key", "left").join(exact("body"), "key", "left")
    count = lambda c: F.coalesce(f"{c}_exact", f"{c}_estimate").cast("long")
    counted = counted.withColumn("sites", count("site")).where((F.col("sites") >= min_sites) & (count("body") >= min_sites))
    return counted.select("key", "sites", "occurrences", "first_id")


def _often(lines: DataFrame) -> int:
    return max(lines.count() // 1000, 1)


def removals(docs: DataFrame, id_col: str, text_col: str, site_col: str, **how) -> DataFrame:
    """doc_id and the keys of its lines to be removed."""
    # the lines of every text are keyed once; sketches, exact counts and removals read the keys
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.write("lines", _rows(docs, id_col, text_col, site_col))
    spread = scratch.write("spread", _spread(lines, scratch, **how))
    own = lines.select("doc_id", "key").where("doc_id is not null")
    hit = _matched(own, spread.select("key", "first_id", "occurrences"), _often(lines)).where("doc_id != first_id")
    return hit.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", **how) -> DataFrame:
    """``docs`` with boilerplate lines removed from the text, and line_n_removed."""
    docs = without(docs, "line_n_removed")
    own, keys, kept = unused(docs, "id"), unused(docs, "keys"), unused(docs, "kept")
    gone = removals(docs, id_col, text_col, site_col, **how).select(F.col("doc_id").alias(own), F.col("keys").alias(keys))
    joined = docs.join(gone, F.col(id_col).cast("long") == F.col(own), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(keys, line_key(x)), F.lit(False)))
    joined = joined.withColumn(kept, F.when(F.col(keys).isNotNull(), left))
    text = F.when(F.col(kept).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col(kept).isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")
    others = [F.col(c) for c in docs.columns if c != text_col]
    return joined.select(*others, removed.alias("line_n_removed"), text.alias(text_col)).select(*docs.columns, "line_n_removed")
