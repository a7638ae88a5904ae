"""A training-data pipeline over ``documents``: each stage works on all that the one before kept.

Every stage takes null ids, texts, languages and sources, repeated rows, texts
of any length, empty tables and extra columns of any name, which it returns.
A null or blank text has no language and goes in the first stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import bpe, langid, mixing, quality, simhash
from lexiloom.llm.queries import held_out
from lexiloom.llm.shelf import Shelf

#: Language predictions under this score are rejected; a sure prediction scores near one.
LEAST_SCORE = 0.3


def _keyed(docs: DataFrame, shelf: Shelf) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, in a column of a new name, written once so that every reader sees the same."""
    key = "__row"
    while key in map(str.lower, docs.columns):
        key += "_"
    return shelf.keep(docs.withColumn(key, F.monotonically_increasing_id())), key


def _all(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language."""
    model = langid.fit_languages(docs.where(~held_out(F.col("doc_id"))))
    return langid.keep_recognised(docs, model, LEAST_SCORE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality rules don't keep."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id; null ids come last, and one of rows that repeat an id stays.

    The rows' keys are the small side of a hash join, so the texts aren't sorted.
    """
    shelf = Shelf(spark)
    keyed, key = _keyed(docs, shelf)
    groups = simhash.simhash_groups(keyed, id_col=key).select("id", "component_id")
    first = keyed.select(F.col(key).alias("k"), F.col("doc_id").alias("d")).join(groups.hint("shuffle_hash"), F.col("k") == F.col("id"))
    kept = first.groupBy("component_id").agg(F.min(F.struct(F.col("d").isNull().alias("none"), "d", "k")).alias("least")).select(F.col("least.k").alias(key))
    return keyed.join(kept.hint("shuffle_hash"), key, "left_semi").select(*_all(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows that share an id, or have none, are taken one by one.

    A null source is a source; a null or blank text has no words and is taken by
    its source's rate alone, so it may come back up to twice or not at all.
    """
    keyed, key = _keyed(docs, Shelf(spark))
    copies = mixing.mix_sources(keyed, key_col=key).where("copies > 0").select(F.col("key").alias(key), F.sequence(F.lit(1), "copies").alias(key + "n"))
    # ``docs`` has none of these names.
    return keyed.join(copies.hint("shuffle_hash"), key).select(*_all(docs), F.explode(key + "n").alias(key + "i")).select(*_all(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document, with digests of the ids and of the decoded text."""
    return bpe.bpe_encode(docs, emit=("ids", "ids_sha256", "decoded_sha256")).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language), ("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("source_mixing", mix), ("bpe_encoding", encode)]

#: No SQL expresses the language model; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    shelf = Shelf(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shelf.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
