"""A training corpus from ``documents``: five stages, each over all that the one before kept.

1. the quality classifier drops documents that it rejects;
2. lines spread over many sites are removed, but for their first occurrence;
3. one document stays of each group of near-duplicates (five-word shingles, similarity 0.8);
4. documents that contain benchmark passages go;
5. sources are mixed to target weights: documents repeat, or are left out, by their rate.

Stages but the last return the columns of ``documents``; the last adds ``copy``, from 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontam, line_dedup, mixing, near_dedup, quality
from weftline.llm.scratch import Scratch


def _side(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _side(spark, sf_dir, "labels"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_boilerplate(docs)
    size = F.when(F.col("line_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", size).select(*docs.columns) if "n_chars" in docs.columns else cut.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, cfg=near_dedup.ChosenPath(shingle=5, similarity=80))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, _side(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emitted(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_boilerplate),
    ("near-dedup", one_of_each_group),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
]

#: The classifier can't be expressed in SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = _side(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = scratch.write(f"stage{n}", stage(spark, docs, sf_dir))
        if n:
            scratch.drop(f"stage{n - 1}")
    return docs
