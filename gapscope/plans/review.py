"""Second opinion on CRITICAL clusters from the ten closest articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscope.functions.text import snippet, strip
from gapscope.models import ChatFn, with_reply
from gapscope.operators.similarity import Side, top_k
from gapscope.plans import counts

RUN_CLUSTER = ("run_id", "cluster_id")
REPLY_KEYS = ("match_found", "matched_kb_id", "matched_kb_title", "confidence", "reasoning")
REPLY_TYPE = "match_found boolean, matched_kb_id string, matched_kb_title string, confidence string, reasoning string"
SNIPPET = 500


def has_keys(reply: Column, keys: Sequence[str]) -> Column:
    """Whether a JSON reply parses and holds every key."""
    parsed = F.from_json(reply, "map<string,string>")
    found = F.lit(True)
    for key in keys:
        found = found & F.map_contains_key(parsed, key)
    return F.coalesce(found, F.lit(False))


def candidates(clusters: DataFrame, articles: DataFrame, k: int = 10, chars: int = SNIPPET, **layout) -> DataFrame:
    """The ``k`` closest articles of every cluster with rank, similarity and snippet.

    ``articles`` has kb_id, title, solution and kb_vec. Texts join after the ranking,
    so they never travel with the vectors.
    """
    left = Side(clusters, "centroid", [*[c for c in RUN_CLUSTER if c in clusters.columns]])
    left = Side(left.frame.withColumn("__c", F.struct(*left.columns)), "centroid", ["__c"])
    hits = top_k(left, Side(articles, "kb_vec", ["kb_id"]), k, **layout)
    texts = articles.select("kb_id", "title", snippet(strip(F.coalesce("solution", F.lit(""))), chars).alias("snippet"))
    return hits.join(texts, "kb_id").select(
        "__c.*", "rank", "kb_id", "title", "snippet", F.round("sim", 4).alias("sim")
    )


def candidate_prompts(clusters: DataFrame, found: DataFrame) -> DataFrame:
    """One prompt per cluster: what it is about, then its candidates in order."""
    keys = [c for c in RUN_CLUSTER if c in clusters.columns]
    block = F.format_string(
        "%d. Title: %s\n   Vector similarity: %s\n   Content: %s",
        F.col("rank"), F.col("title"), F.format_string("%.4f", "sim"),
        F.when(F.col("snippet") == "", "(no content)").otherwise(F.replace("snippet", F.lit("\n"), F.lit(" "))),
    )
    listed = found.withColumn("__b", block).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "__b"))).alias("__l")
    )
    joined = clusters.join(listed, keys)
    prompt = F.concat(
        F.lit("A cluster of support tickets found no article close enough by vector.\n"),
        F.lit("Decide whether one of the candidates settles it all the same.\n\nLabel: "), F.col("cluster_label"),
        F.lit("\nTop terms: "), F.coalesce("top_terms", F.lit("")),
        F.lit("\nTickets: "), F.col("size").cast("string"),
        F.lit("\nSummary: "), F.coalesce("summary", F.lit("")),
        F.lit("\n\nCandidates:\n"), F.array_join(F.transform("__l", lambda b: b["__b"]), "\n"),
        F.lit("\n\nReply with one JSON object with the keys " + ", ".join(REPLY_KEYS) + "."),
    )
    return joined.select(*keys, prompt.alias("prompt"))


def opinions(prompts: DataFrame, chat_fn: ChatFn) -> DataFrame:
    """Replies as columns; a reply that does not parse or lacks a key gives no row."""
    return parse_opinions(with_reply(prompts, F.array("prompt"), chat_fn))


def parse_opinions(replies: DataFrame) -> DataFrame:
    """``replies`` has the cluster's keys and the model's JSON."""
    keys = [c for c in RUN_CLUSTER if c in replies.columns]
    whole = replies.where(has_keys(F.col("reply"), REPLY_KEYS))
    return whole.withColumn("r", F.from_json("reply", REPLY_TYPE)).select(*keys, "r.*")


def store_opinions(clusters: DataFrame, found: DataFrame) -> DataFrame:
    """Clusters with ``review_match``, ``review_confidence`` and ``review_reason``."""
    news = found.select(
        *RUN_CLUSTER, F.lit(True).alias("__r"), F.col("matched_kb_title").alias("__m"),
        F.col("confidence").alias("__c"), F.col("reasoning").alias("__w"),
    )
    joined = clusters.join(news, list(RUN_CLUSTER), "left")
    kept = lambda c: F.col(c) if c in clusters.columns else F.lit(None).cast("string")
    new = {"review_match": "__m", "review_confidence": "__c", "review_reason": "__w"}
    rest = [c for c in clusters.columns if c not in new]
    return joined.select(
        *rest, *[F.when(F.col("__r"), F.col(v)).otherwise(kept(c)).alias(c) for c, v in new.items()]
    )


def is_override(match_found: Column, confidence: Column, title: Column) -> Column:
    return F.coalesce(match_found & (F.upper(confidence) == "HIGH") & (title != ""), F.lit(False))


def override_flags(table: DataFrame, found: DataFrame) -> DataFrame:
    """CRITICAL rows with a sure match become PARTIAL; a recommendation is rewritten if there is one."""
    sure = found.where(is_override(F.col("match_found"), F.col("confidence"), F.col("matched_kb_title"))).select(
        *RUN_CLUSTER, F.col("matched_kb_title").alias("__t")
    )
    joined = table.join(sure, list(RUN_CLUSTER), "left")
    hit = F.col("__t").isNotNull() & (F.col("gap_flag") == "CRITICAL")
    text = F.concat(
        F.lit("UPDATE: Expand '"), snippet(F.col("__t"), 50), F.lit("' to cover this cluster (LLM-validated)")
    )
    new = {"gap_flag": F.lit("PARTIAL"), "recommendation": text}
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns])


def asked(critical: DataFrame, found: DataFrame) -> DataFrame:
    """A row per cluster asked about, with its opinion where there is one (``answered``)."""
    return critical.select(*RUN_CLUSTER).join(found.withColumn("answered", F.lit(True)), list(RUN_CLUSTER), "left")


def review_counts(critical: DataFrame, found: DataFrame) -> DataFrame:
    """Clusters asked about, matches by confidence, no match, overrides, failed calls."""
    return counts.row(asked(critical, found), counts.opinions())
