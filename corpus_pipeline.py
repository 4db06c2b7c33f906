"""From raw documents to packed training sequences: five stages, each over all that the one before it kept.

A stage takes (session, documents, table folder) and returns a table that is written and read
again before the next one starts, so a lost executor repeats parts of one stage only. All but
the last keep the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapscope.llm import langid, linededup, ngramjoin, packing, quality
from gapscope.llm.common import cut, small_batches, text_key
from gapscope.llm.queries import vocabulary
from gapscope.operators.rounds import numbered

#: Below this score a text is out of place in every language that was learned.
LEAST_SCORE = 0.1
#: Near-duplicate texts share this share (in hundredths) of their shingles of so many words.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus teaches."""
    small_batches(spark)
    found = docs.withColumn("__found", langid.predict(F.col("text"), langid.learn(docs)))
    return found.where((F.col("__found.lang_pred") != "und") & (F.col("__found.score") >= LEAST_SCORE)).select(docs.columns)


def good_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    small_batches(spark)
    field = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.withColumn("__judged", quality.judge(F.col("text"), field)).where("__judged.kept").select(docs.columns)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occurred before; those that lose every word go."""
    left = linededup.dedup(docs).where((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines")))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("changed"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(docs.columns)


def members(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__member``: one number for each doc_id and text, in the order of doc_id; null without a doc_id."""
    keyed = docs.withColumn("__text", text_key(F.col("text")))
    names = numbered(keyed.where(F.col("doc_id").isNotNull()).select("doc_id", "__text").distinct(), ["doc_id", "__text"], "__member")
    return keyed.join(names, ["doc_id", "__text"], "left").drop("__text")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies. Rows without a doc_id stay.

    Unlike texts that share a doc_id are documents of their own; of rows with one doc_id and text, one stays.
    """
    repeated = not docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").isEmpty()
    named = cut(members(docs)) if repeated else docs.withColumn("__member", F.col("doc_id"))
    groups = ngramjoin.join(named.select(F.col("__member").alias("doc_id"), "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    gone = cut(groups.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("__member")).distinct())
    kept = named.join(ngramjoin.sent(gone, gone.count()), "__member", "left_anti")
    if repeated:
        first = Window.partitionBy("__member").orderBy(F.md5(F.to_json(F.struct(*docs.columns))))
        ranked = kept.where(F.col("__member").isNotNull()).withColumn("__r", F.row_number().over(first)).where("__r = 1")
        kept = kept.where(F.col("__member").isNull()).unionByName(ranked.drop("__r"))
    return kept.select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("quality", good_lines), ("line dedup", fresh_lines), ("near duplicates", one_of_each), ("packing", sequences),
]
#: SQL can express neither the learned stages nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
