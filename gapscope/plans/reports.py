"""Report queries over the per-run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapscope.functions.text import (
    canonical_from_recommendation,
    confidence_label,
    nan_to_null,
    parse_lines,
    parse_list,
    snippet,
)

FLAGS = ("CRITICAL", "PARTIAL", "COVERED", "DUPLICATE")
SOURCES = ("incident", "workorder")


def source_counts(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("run_id", "cluster_id").agg(
        F.count_if(F.col("source") == "workorder").alias("wo_tickets"),
        F.count_if(F.col("source") == "incident").alias("inc_tickets"),
    )


def run_list(
    runs: DataFrame,
    clusters: DataFrame,
    hidden: Sequence[str] = (),
    include_hidden: bool = False,
    require_clusters: bool = True,
    most: int | None = 20,
) -> DataFrame:
    """The first ``most`` runs with clusters (all if None), complete ones first, then newest; hidden ones dropped or marked."""
    listed = runs.join(clusters.select("run_id"), "run_id", "left_semi") if require_clusters else runs
    mark = F.col("run_id").isin(*hidden) if hidden else F.lit(False)
    listed = listed.select("run_id", "started_at", "status", mark.alias("hidden"))
    if not include_hidden:
        listed = listed.where(~F.col("hidden"))
    order = F.when(F.col("status") == "complete", 0).when(F.col("status") == "running", 1).otherwise(2)
    ordered = listed.orderBy(order, F.desc("started_at"), "run_id")
    return ordered if most is None else ordered.limit(most)


def latest_run(runs: DataFrame, needed: DataFrame) -> DataFrame:
    """Newest run with rows in the table the next step needs."""
    return runs.join(needed.select("run_id"), "run_id", "left_semi").orderBy(F.desc("started_at"), "run_id").limit(1)


def cluster_list(
    clusters: DataFrame,
    gaps: DataFrame,
    matches: DataFrame,
    assignments: DataFrame,
    *,
    source: str | None = None,
    excluded: DataFrame | None = None,
) -> DataFrame:
    """Clusters with resolved flag, canonical id, matching article and source counts, by size.

    ``matches`` (run_id, cluster_id, matched_kb_title, confidence, reasoning) fills in
    where the cluster has no match of its own. A CRITICAL cluster with a sure match is
    shown as PARTIAL. ``excluded`` lists run_id and cluster_id to leave out.
    """
    key = ["run_id", "cluster_id"]
    base = clusters.join(excluded, key, "left_anti") if excluded is not None else clusters
    if source is not None:
        base = base.join(assignments.where(F.col("source") == source).select(*key), key, "left_semi")
    g = gaps.select(*key, F.col("gap_flag").alias("__flag"), F.col("recommendation").alias("__text"))
    m = matches.select(*key, F.col("matched_kb_title").alias("__m"), F.col("confidence").alias("__c"), F.col("reasoning").alias("__w"))
    joined = base.join(g, key, "left").join(m, key, "left").join(source_counts(assignments), key, "left")
    flag = F.coalesce("__flag", "gap_flag")
    empty = F.coalesce("review_match", F.lit("")) == ""
    fill = lambda own, other: F.when(empty, F.col(other)).otherwise(F.col(own))
    match, confidence = fill("review_match", "__m"), fill("review_confidence", "__c")
    sure = (flag == "CRITICAL") & (confidence == "HIGH") & (match != "")
    return joined.select(
        *key, "cluster_label", "size",
        F.when(F.coalesce(sure, F.lit(False)), "PARTIAL").otherwise(flag).alias("gap_flag"),
        *[nan_to_null(F.col(c)).alias(c) for c in ("max_kb_sim", "silhouette", "pca_x", "pca_y") if c in clusters.columns],
        F.nullif("summary", F.lit("")).alias("summary"),
        F.nullif(match, F.lit("")).alias("review_match"), F.nullif(confidence, F.lit("")).alias("review_confidence"),
        F.nullif(fill("review_reason", "__w"), F.lit("")).alias("review_reason"),
        F.when(flag == "DUPLICATE", canonical_from_recommendation(F.col("__text"))).alias("canonical_cluster_id"),
        F.coalesce("wo_tickets", F.lit(0)).alias("wo_tickets"), F.coalesce("inc_tickets", F.lit(0)).alias("inc_tickets"),
    ).orderBy(F.desc("size"), *key)


def tickets_of(assignments: DataFrame, tickets: DataFrame, clusters: Sequence[int] | None = None) -> DataFrame:
    """Ticket details of the given clusters, by cluster, source, number; of all, in no order.

    Sorting every ticket with its texts would move them all for an order no one reads.
    """
    kept = assignments.where(F.col("cluster_id").isin(*clusters)) if clusters else assignments
    texts = tickets.select("source", "source_id", "problem_text", F.coalesce("resolution_text", F.lit("")).alias("resolution_text"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    details = kept.join(texts, ["source", "source_id"]).select(
        "run_id", "cluster_id", "source", blank("ticket_number"), blank("service_type"), blank("assigned_group"),
        "problem_text", "resolution_text",
    )
    return details.orderBy("run_id", "cluster_id", "source", "ticket_number") if clusters else details


def sweep_rows(swept: DataFrame) -> DataFrame:
    return swept.select("run_id", "k", "inertia", "silhouette", "is_best_k").orderBy("run_id", "k")


def service_breakdown(assignments: DataFrame, gaps: DataFrame, source: str | None = None) -> DataFrame:
    """Tickets per service type and flag. Tickets are counted per cluster before the join."""
    kept = assignments.where(F.col("source") == source) if source else assignments
    counted = kept.groupBy("run_id", "cluster_id", "service_type").agg(F.count("*").alias("n"))
    flags = gaps.select("run_id", "cluster_id", "gap_flag")
    return (
        counted.join(flags, ["run_id", "cluster_id"]).groupBy("run_id", "service_type", "gap_flag")
        .agg(F.sum("n").alias("tickets")).orderBy(F.desc("tickets"), "run_id", "service_type", "gap_flag")
    )


def source_mix(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("run_id", "source").agg(F.count("*").alias("tickets"))


def source_mix_per_cluster(assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    counted = assignments.groupBy("run_id", "cluster_id", "source").agg(F.count("*").alias("tickets"))
    names = clusters.select("run_id", "cluster_id", "cluster_label")
    return counted.join(names, ["run_id", "cluster_id"]).select("run_id", "cluster_id", "cluster_label", "source", "tickets")


def workorder_clusters(assignments: DataFrame) -> DataFrame:
    """Clusters of a run with work orders, and those where they are more than half."""
    return workorder_counts(source_counts(assignments))


def workorder_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("run_id").agg(
        F.count_if(F.col("wo_tickets") > 0).alias("clusters_with_wo"),
        F.count_if(F.col("wo_tickets") / (F.col("wo_tickets") + F.col("inc_tickets")) > 0.5).alias("wo_dominant"),
    )


def incident_dominant(assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    total = clusters.groupBy("run_id").agg(F.count("*").alias("total_clusters"))
    joined = total.join(workorder_clusters(assignments), "run_id", "left").fillna(0)
    return joined.withColumn("inc_dominant", F.col("total_clusters") - F.col("wo_dominant"))


def article_list(articles: DataFrame, assignments: DataFrame) -> DataFrame:
    """Drafts by quality with parsed lists and the work orders of their cluster."""
    wo = assignments.where("source = 'workorder'").groupBy("run_id", "cluster_id").agg(F.count("*").alias("wo_in_cluster"))
    is_text = lambda c: articles.schema[c].dataType.typeName() == "string"
    steps = parse_list(F.col("resolution_steps")) if is_text("resolution_steps") else F.when(F.size("resolution_steps") > 0, F.col("resolution_steps"))
    return articles.join(wo, ["run_id", "cluster_id"], "left").select(
        "run_id", "cluster_id", "title", "category", F.col("quality_score").cast("double").alias("quality_score"),
        confidence_label(F.col("confidence")).alias("confidence"), "needs_review", "problem_statement",
        parse_lines(F.col("symptoms")).alias("symptoms") if "symptoms" in articles.columns else F.lit(None).cast("array<string>").alias("symptoms"),
        steps.alias("resolution_steps"), F.nullif("additional_notes", F.lit("")).alias("additional_notes"),
        F.nullif("is_duplicate_of", F.lit("None")).alias("is_duplicate_of"),
        F.coalesce("wo_in_cluster", F.lit(0)).alias("wo_in_cluster"),
    ).orderBy(F.desc("quality_score"), "run_id", "cluster_id")


def _is_duplicate() -> Column:
    return F.coalesce(F.col("is_duplicate_of"), F.lit("None")) != "None"


def article_stats(articles: DataFrame, results: DataFrame) -> DataFrame:
    """Canonical, duplicate, to review, validated drafts and the average quality of a run."""
    a = articles.groupBy("run_id").agg(
        F.count_if(~_is_duplicate()).alias("canonical"), F.count_if(_is_duplicate()).alias("duplicates"),
        F.round(F.avg("quality_score"), 1).alias("avg_quality"), F.count_if("needs_review").alias("needs_review"),
    )
    v = results.where("validation_status = 'VALIDATED'").groupBy("run_id").agg(F.count("*").alias("validated"))
    return a.join(v, "run_id", "left").fillna(0, ["validated"])


def existing_articles(articles: DataFrame, use: DataFrame) -> DataFrame:
    """All existing articles by title with their use in a run."""
    u = use.select("kb_id", F.col("status").alias("util_status"), F.col("clusters_as_best").alias("util_count"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return articles.select("kb_id", "title", blank("issue"), blank("solution")).join(u, "kb_id", "left").orderBy("title", "kb_id")


def existing_stats(articles: DataFrame, use: DataFrame) -> DataFrame:
    listed = existing_articles(articles, use)
    hit = lambda s: F.count_if(F.col("util_status") == s)
    return listed.agg(
        F.count("*").alias("total"), hit("ACTIVE").alias("active"), hit("ORPHAN").alias("orphaned"),
        hit("OVER-RELIED").alias("over_relied"),
    )


def gap_distribution(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("run_id", "gap_flag").agg(F.count("*").alias("clusters"), F.sum("size").alias("tickets"))


def flag_totals(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("run_id").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("gap_flag") == f).alias(f.lower()) for f in FLAGS]
    )


def largest_clusters(clusters: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` largest clusters of each run, labels cut at 42 characters."""
    w = Window.partitionBy("run_id").orderBy(F.desc("size"), "cluster_id")
    top = clusters.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return top.select("run_id", "place", "cluster_id", snippet(F.col("cluster_label"), 42).alias("label"), "size", "gap_flag")


def service_pivot(breakdown: DataFrame) -> DataFrame:
    """One row per service type, a column per flag with zeros, by row total."""
    wide = breakdown.groupBy("run_id", "service_type").pivot("gap_flag", list(FLAGS)).agg(F.sum("tickets")).fillna(0, list(FLAGS))
    total = sum((F.col(f) for f in FLAGS), F.lit(0))
    return wide.select("run_id", "service_type", *[F.col(f).alias(f.lower()) for f in FLAGS], total.alias("total")).orderBy(
        "run_id", "total", "service_type"
    )


def source_pivot(mix: DataFrame, n: int = 30) -> DataFrame:
    """Clusters with incident and work-order tickets side by side, the ``n`` largest per run."""
    wide = mix.groupBy("run_id", "cluster_id", "cluster_label").pivot("source", list(SOURCES)).agg(F.sum("tickets")).fillna(0, list(SOURCES))
    wide = wide.withColumn("total", F.col("incident") + F.col("workorder"))
    w = Window.partitionBy("run_id").orderBy(F.desc("total"), "cluster_id")
    top = wide.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return top.select("run_id", "place", "cluster_id", snippet(F.col("cluster_label"), 38).alias("label"), "incident", "workorder", "total")


def merged_sizes(listed: DataFrame) -> DataFrame:
    """Own size plus that of the duplicates pointing here, and those duplicates by size.

    ``listed`` has run_id, cluster_id, size, cluster_label, gap_flag, canonical_cluster_id.
    """
    dup = listed.where("gap_flag = 'DUPLICATE'").groupBy("run_id", F.col("canonical_cluster_id").alias("cluster_id")).agg(
        F.sum("size").alias("__size"),
        F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "cluster_id", "cluster_label"))).alias("__dups"),
    )
    joined = listed.join(dup, ["run_id", "cluster_id"], "left")
    return joined.select(
        "run_id", "cluster_id", "size", (F.col("size") + F.coalesce("__size", F.lit(0))).alias("merged_size"),
        F.coalesce(F.transform("__dups", lambda d: d["cluster_id"]), F.array().cast("array<bigint>")).alias("duplicates"),
    )


def filter_clusters(listed: DataFrame, flags: Sequence[str] = (), text: str = "") -> DataFrame:
    kept = listed.where(F.col("gap_flag").isin(*flags)) if flags else listed
    return kept.where(F.lower("cluster_label").contains(text.lower())) if text else kept


def visible_articles(articles: DataFrame, hidden: DataFrame, text: str = "") -> DataFrame:
    """Drafts outside the hidden clusters whose title or category holds ``text``."""
    kept = articles.join(hidden, ["run_id", "cluster_id"], "left_anti")
    if not text:
        return kept
    find = lambda c: F.lower(c).contains(text.lower())
    return kept.where(find("title") | find("category"))


def filter_existing(listed: DataFrame, text: str = "", status: str | None = None) -> DataFrame:
    kept = listed
    if text:
        find = lambda c: F.lower(c).contains(text.lower())
        kept = kept.where(find("title") | find("issue"))
    return kept.where(F.col("util_status") == status) if status else kept


def scatter(clusters: DataFrame) -> DataFrame:
    placed = clusters.where(F.col("pca_x").isNotNull() & F.col("pca_y").isNotNull())
    return placed.select("run_id", "gap_flag", "cluster_id", "cluster_label", "size", "pca_x", "pca_y").orderBy("run_id", "gap_flag", "cluster_id")


def best_k(swept: DataFrame) -> DataFrame:
    return swept.where("is_best_k")
