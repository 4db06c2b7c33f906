"""Sources, context and messages for a batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapscope.config import Thresholds
from gapscope.functions.text import snippet, strip
from gapscope.operators.similarity import Side, top_k


def retrieve(questions: DataFrame, index: DataFrame, k: int = 4, **layout) -> DataFrame:
    """The ``k`` closest index entries of the question's run, with rank and snippet.

    ``questions`` has conv_id, run_id, query_vec. Entry texts join the hits afterwards.
    """
    entries = index.withColumn("entry", F.concat_ws(":", "source", "source_id"))
    hits = top_k(
        Side(questions, "query_vec", ["conv_id"]), Side(entries, "embedding", ["entry"]), k, by=["run_id"], **layout
    )
    texts = entries.select(
        "run_id", "entry", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("category", F.lit("")).alias("category"),
        strip(snippet(F.coalesce("content", F.lit("")), 400)).alias("snippet"), "is_generated",
    )
    return hits.join(texts, ["run_id", "entry"]).withColumn("similarity", F.greatest(F.lit(0.0), F.col("sim"))).drop("sim")


def shown_sources(hits: DataFrame, bound: float = Thresholds.shown_source) -> DataFrame:
    return hits.where(F.col("similarity") >= bound)


def contexts(hits: DataFrame) -> DataFrame:
    """One text per question: every hit, shown or not, in rank order."""
    kind = F.when(F.col("is_generated"), "Generated KB").otherwise("Existing KB")
    block = F.format_string("[%d] %s (%s | %s)\n%s", "rank", "title", kind, "category", "snippet")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda s: s["b"])
    return hits.groupBy("conv_id").agg(F.array_join(ordered, "\n\n").alias("context"))


def messages(history: DataFrame, questions: DataFrame, context: DataFrame, keep: int = 12) -> DataFrame:
    """Messages per conversation: system, the last turns, the question.

    The cut to the last ``keep`` turns comes before roles are filtered. ``history`` has
    conv_id, turn, role, text; the rank filter bounds what a long conversation sends.
    """
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = history.withColumn("back", F.row_number().over(w)).where(F.col("back") <= keep)
    said = last.where(F.col("role").isin("user", "assistant")).groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
            lambda s: F.struct(s["role"].alias("role"), s["text"].alias("content")),
        ).alias("said")
    )
    one = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))
    joined = questions.join(said, "conv_id", "left").join(context, "conv_id", "left")
    body = F.concat(
        one("system", F.coalesce("context", F.lit(""))),
        F.coalesce("said", F.array().cast("array<struct<role:string,content:string>>")),
        one("user", F.col("question")),
    )
    return joined.select("conv_id", body.alias("messages"))
