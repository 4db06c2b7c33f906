"""First step: clean text, choose and blend vectors, filter by quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscope.config import Thresholds
from gapscope.functions import text as tx
from gapscope.functions import vectors as vc
from gapscope.models import EmbedFn, with_vector
from gapscope.plans import counts


def incident_features(incidents: DataFrame) -> DataFrame:
    """Problem vector, word count and evidence tier of every incident."""
    generic = tx.is_generic_subject(F.col("description"))
    problem = vc.incident_problem_vector(generic, F.col("e_description"), F.col("e_detailed_description"))
    return incidents.select(
        "id",
        generic.alias("generic_subject"),
        problem.alias("problem_vec"),
        F.col("e_resolution_summary").alias("res_vec"),
        tx.word_count(F.col("resolution_summary")).alias("res_word_count"),
        tx.evidence_tier(F.col("resolution_summary")).alias("evidence_tier"),
    )


def judge_incidents(features: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``quality_pass`` and the first failing rule; rows stay, with the flag."""
    reason = (
        F.when(F.col("problem_vec").isNull() | F.col("res_vec").isNull(), "no-vector")
        .when(F.col("res_word_count") < t.min_resolution_words, "short")
    )
    return features.withColumn("drop_reason", reason).withColumn("quality_pass", F.col("drop_reason").isNull())


def worth_embedding(clean_words: Column, boilerplate: Column, t: Thresholds = Thresholds()) -> Column:
    return (clean_words >= t.min_clean_words) & ~boilerplate


def clean_workorders(workorders: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Mail noise stripped, with word count, template flag and the mask of texts to embed."""
    return (
        workorders.withColumn("clean_text", tx.strip_email_noise(F.col("detailed_description")))
        .withColumn("clean_words", tx.word_count(F.col("clean_text")))
        .withColumn("boilerplate", tx.is_boilerplate(F.col("clean_text")))
        .withColumn("to_embed", worth_embedding(F.col("clean_words"), F.col("boilerplate"), t))
    )


def embed_workorders(cleaned: DataFrame, embed_fn: EmbedFn) -> DataFrame:
    """Vector of the cleaned text as ``e_clean``; masked texts are not sent."""
    return with_vector(cleaned, F.when(F.col("to_embed"), F.col("clean_text")), embed_fn, "e_clean")


def workorder_features(cleaned: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Problem vector, counts and tier of every work order (needs ``e_clean``)."""
    detail = F.when(F.col("to_embed"), F.col("e_clean"))
    problem = vc.workorder_problem_vector(
        F.col("boilerplate"), F.col("e_description"), detail, F.col("e_activity_logs")
    )
    activity = F.col("activity_logs_text")
    return cleaned.select(
        "id", "clean_words", "boilerplate", "to_embed",
        problem.alias("problem_vec"),
        F.col("e_activity_logs").alias("res_vec"),
        tx.word_count(activity).alias("res_word_count"),
        tx.evidence_tier(activity).alias("evidence_tier"),
        tx.is_email_dominated(activity, t.email_share).alias("email_dominated"),
    )


def judge_workorders(
    features: DataFrame, t: Thresholds = Thresholds(), boilerplate_first: bool = False
) -> DataFrame:
    """As ``judge_incidents``, in the order short, no-detail, boilerplate, e-mail."""
    reason = F.when(F.col("problem_vec").isNull() | F.col("res_vec").isNull(), "no-vector").when(
        F.col("res_word_count") < t.min_activity_words, "short"
    )
    template = (F.col("boilerplate"), "boilerplate")
    detail = (~F.col("to_embed"), "no-detail")
    for fault, name in (template, detail) if boilerplate_first else (detail, template):
        reason = reason.when(fault, name)
    reason = reason.when(F.col("email_dominated"), "email")
    return features.withColumn("drop_reason", reason).withColumn("quality_pass", F.col("drop_reason").isNull())


def drop_funnel(judged: DataFrame) -> DataFrame:
    """Rows per first failing rule, and those that pass, in one row."""
    return counts.row(judged, counts.funnel())


def embeddings_table(judged: DataFrame, source: str, run_id: str) -> DataFrame:
    """Rows of the ticket vector table: both vectors of length one."""
    return judged.select(
        F.lit(source).alias("source"), F.col("id").cast("string").alias("source_id"), F.lit(run_id).alias("run_id"),
        vc.normalise(F.col("problem_vec")).alias("problem_vec"), vc.normalise(F.col("res_vec")).alias("res_vec"),
        "quality_pass", "drop_reason", "res_word_count", "evidence_tier",
    )


def step_statistics(incidents: DataFrame, workorders: DataFrame, articles: DataFrame) -> DataFrame:
    """Totals and usable rows of both sources and the article count, one row."""
    count = lambda df, kind: df.groupBy().agg(
        F.lit(kind).alias("kind"), F.count("*").alias("total"), F.count_if("quality_pass").alias("usable")
    )
    kb = articles.groupBy().agg(F.lit("kb").alias("kind"), F.count("*").alias("total"), F.count("*").alias("usable"))
    rows = count(incidents, "incident").unionByName(count(workorders, "workorder")).unionByName(kb)
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return rows.agg(
        pick("incident", "total").alias("total_incidents"), pick("incident", "usable").alias("usable_incidents"),
        pick("workorder", "total").alias("total_workorders"), pick("workorder", "usable").alias("usable_workorders"),
        (pick("incident", "usable") + pick("workorder", "usable")).alias("total_embedded"),
        pick("kb", "total").alias("kb_articles"),
    )
