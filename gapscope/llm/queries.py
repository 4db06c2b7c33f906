"""Registered queries of this subpackage: name -> plan over (session, table folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscope.llm import bpe, collocations, htmltext, langid, linededup, linkrank, ngramjoin, packing, quality, repair, sharding, vectordedup, warc

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
TWINS: dict[str, str] = {}
WORD_BPE = "word_bpe_49k.json"


def vocabulary(name: str = WORD_BPE) -> str:
    """Path of a public vocabulary file, the same on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def keep(plan: Plan) -> Plan:
        PLANS[name] = plan
        if sql is not None:
            TWINS[name] = sql
        return plan

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_warc")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages").select("page_id", "url", "html"))


@query("op2_language")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = langid.predict(F.col("text"), langid.learn(docs)).alias("p")
    return docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), found).select("doc_id", "held_out", "p.*")


@query("op3_main_text")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.extract(table(spark, folder, "pages").select("page_id", "url", "html"))


@query("op4_bpe")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", bpe.digests(F.col("text"), vocabulary()).alias("d")).select("doc_id", "d.*")


@query("op5_vector_dedup", vectordedup.SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return vectordedup.dedup(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))


@query("op6_quality")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    field = quality.learn(docs, table(spark, folder, "labels"))
    return docs.select("doc_id", quality.judge(F.col("text"), field).alias("q")).select("doc_id", "q.*")


@query("op7_sharding")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(table(spark, folder, "documents").select("doc_id", "text"))


@query("op8_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"), vocabulary())


@query("op9_ngram_join", ngramjoin.SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return ngramjoin.join(table(spark, folder, "documents").select("doc_id", "text"))


@query("op10_line_dedup", linededup.SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.dedup(table(spark, folder, "documents").select("doc_id", "text"))


@query("op11_linkrank", linkrank.SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return linkrank.judge(table(spark, folder, "pages").select("page_id", "url", "html"), linkrank.rule_table(spark, linkrank.RULES))


@query("op12_repair")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return repair.report(repair.damage(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")))


@query("op13_collocations", collocations.SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.ranked(table(spark, folder, "documents").select("lang", "text"))
