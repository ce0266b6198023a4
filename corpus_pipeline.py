"""A corpus from raw documents to packed sequences: language, near duplicates, secrets, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklore.llm import jaccard, langid, mixing, packing, secrets
from tasklore.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is rejected go; a missing lang is filled with the predicted one."""
    docs = docs.select(*COLUMNS)
    dicts = langid.dictionaries(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out()))
    found = langid.identify(docs, dicts, keep=("text", "lang", "source", "n_chars")).where("not rejected")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by word shingles, the one with the smallest doc_id stays (null last).

    A document is a doc_id with its text: one doc_id may stand at several texts, each judged by itself; repeated rows are one.
    """
    keyed = docs.select(*COLUMNS).withColumn("key", F.xxhash64("doc_id", "text"))
    found = jaccard.jaccard_components(keyed.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key"))["key"].alias("key")
    stay = keyed.select("key", "doc_id").join(found.distinct(), "key").groupBy("component_id").agg(first).select("key").distinct()
    return keyed.join(stay, "key").dropDuplicates(["key", "doc_id"]).select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked where they stand; every document stays."""
    found = secrets.scan_secrets(docs.select(*COLUMNS), keep=("text", "lang", "source", "n_chars"))
    length = F.when(F.col("masked").isNull(), F.col("n_chars")).otherwise(F.length("masked"))
    return found.withColumn("n_chars", length.cast("long")).withColumn("text", F.coalesce("masked", "text")).select(*COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: not at all, once or twice."""
    mixed = mixing.pareto_mix(docs.select(*COLUMNS), keep=("text", "lang", "n_chars")).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.expr("sequence(1, cast(copies as int))"))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces, as of operator 10."""
    return packing.pack_best_fit(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("mixing_sources", mixing_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenization, compression and a network have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
