"""Draft articles: which gaps, with which evidence, scored and assembled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapscope.config import SEED, UNSTATED_SERVICES, Thresholds
from gapscope.functions import article_rules as ar
from gapscope.functions.text import has_resolution, snippet
from gapscope.models import ChatFn, EmbedFn, with_reply, with_vector
from gapscope.operators.labelling import draw
from gapscope.operators.merging import duplicate_articles
from gapscope.operators.rounds import numbered
from gapscope.plans.gaps import tier_weight

RUN_CLUSTER = ("run_id", "cluster_id")
ARTICLE_TYPE = (
    "title string, category string, keywords array<string>, problem_statement string, "
    "affected_systems array<string>, resolution_steps array<string>, additional_notes string, "
    "escalation_trigger string, confidence double"
)


def critical_gaps(gaps: DataFrame, assignments: DataFrame) -> DataFrame:
    """CRITICAL gaps with the most frequent stated service type, by priority.

    Counting per (cluster, service) first keeps the state of a hot cluster small;
    ties go to the lowest name.
    """
    stated = assignments.where(F.col("service_type").isNotNull() & ~F.col("service_type").isin(*UNSTATED_SERVICES))
    counted = stated.groupBy(*RUN_CLUSTER, "service_type").agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("n"), "service_type")
    mode = counted.groupBy(*RUN_CLUSTER).agg(F.min_by("service_type", order).alias("service_type"))
    return (
        gaps.where("gap_flag = 'CRITICAL'").join(mode, list(RUN_CLUSTER), "left")
        .withColumn("service_type", F.coalesce("service_type", F.lit("Unknown")))
        .orderBy(F.desc("priority_score"), "run_id", "cluster_id")
    )


def balanced_gaps(critical: DataFrame, max_articles: int) -> DataFrame:
    """At most ``max_articles`` gaps per run, shared out over the service types.

    Every type gets its rounded share and at least one; an overdrawn budget is scaled
    down and spare slots go to the types with the best priority.
    """
    budget = F.lit(max_articles)
    types = critical.groupBy("run_id", "service_type").agg(
        F.count("*").alias("n"), F.max("priority_score").alias("best")
    )
    totals = types.groupBy("run_id").agg(F.sum("n").alias("total"))
    types = types.join(totals, "run_id").withColumn(
        "share", F.greatest(F.lit(1), F.bround(budget * F.col("n") / F.col("total")).cast("long"))
    )
    drawn = types.groupBy("run_id").agg(F.sum("share").alias("drawn"))
    scaled = F.greatest(F.lit(1), F.floor(F.col("share") * (budget / F.col("drawn"))))
    types = types.join(drawn, "run_id").withColumn(
        "slots", F.when(F.col("drawn") > budget, scaled).otherwise(F.col("share"))
    )
    used = types.groupBy("run_id").agg(F.sum("slots").alias("used"))
    by_best = Window.partitionBy("run_id").orderBy(F.desc("best"), "service_type")
    types = types.join(used, "run_id").withColumn("place", F.row_number().over(by_best))
    extra = (F.col("drawn") > budget) & (F.col("place") <= budget - F.col("used"))
    types = types.select(
        "run_id", "service_type", "total", (F.col("slots") + F.when(extra, 1).otherwise(0)).alias("slots")
    )
    within = Window.partitionBy("run_id", "service_type").orderBy(F.desc("priority_score"), "cluster_id")
    overall = Window.partitionBy("run_id").orderBy(F.desc("priority_score"), "cluster_id")
    kept = critical.join(types, ["run_id", "service_type"]).withColumn("r", F.row_number().over(within)).where(
        (F.col("total") <= budget) | (F.col("r") <= F.col("slots"))
    )
    return kept.withColumn("r", F.row_number().over(overall)).where(F.col("r") <= budget).drop("r", "total", "slots")


def partial_gaps(gaps: DataFrame, articles: DataFrame) -> DataFrame:
    """PARTIAL gaps with the text of their closest article, joined by its id."""
    text = articles.select(
        F.col("kb_id").alias("best_kb_id"), F.col("issue").alias("kb_issue"), F.col("solution").alias("kb_solution")
    )
    return gaps.where("gap_flag = 'PARTIAL'").join(text, "best_kb_id", "left").orderBy(
        F.desc("priority_score"), "run_id", "cluster_id"
    )


def cluster_evidence(
    assignments: DataFrame, tickets: DataFrame, rows: DataFrame, n: int = 5, seed: int = SEED
) -> DataFrame:
    """Up to ``n`` problem and resolution pairs per cluster, best tier first, drawn within a tier.

    One pass for all clusters. The rank is taken on ids, so a large cluster is cut to
    ``n`` rows per partition before its shuffle; texts join the rows that are left.
    """
    key = ["source", "source_id"]
    usable = tickets.where(has_resolution(F.col("resolution_text"))).select(*key)
    tiers = rows.select("run_id", *key, "evidence_tier")
    ids = (
        assignments.select(*RUN_CLUSTER, *key).join(usable, key, "left_semi")
        .join(tiers, ["run_id", *key], "left")
        .select(*RUN_CLUSTER, *key, F.coalesce("evidence_tier", F.lit(4)).alias("tier"), draw(seed, *key).alias("draw"))
    )
    w = Window.partitionBy(*RUN_CLUSTER).orderBy("tier", "draw", *key)
    picked = ids.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n).drop("draw")
    # The ``n`` ids of a cluster go to the texts; joined by a shuffle, every text would move.
    return tickets.select(*key, "problem_text", "resolution_text").join(F.broadcast(picked), key).select(*picked.columns, "problem_text", "resolution_text")


def evidence_scores(gaps: DataFrame, evidence: DataFrame) -> DataFrame:
    """``evidence_count`` and ``ev_quality`` in 0..1 for every gap; none gives 0."""
    scored = evidence.groupBy(*RUN_CLUSTER).agg(
        F.count("*").alias("evidence_count"),
        F.least(F.lit(1.0), F.sum(tier_weight(F.col("tier"))) / (3.0 * F.count("*"))).alias("ev_quality"),
    )
    return gaps.join(scored, list(RUN_CLUSTER), "left").fillna(0, ["evidence_count", "ev_quality"])


def evidence_block(evidence: DataFrame, problem: int = 400, resolution: int = 600) -> DataFrame:
    """Evidence of a cluster as an array of items in pick order (five at most)."""
    item = F.concat(
        F.lit("<item>\n<problem>"), snippet(F.coalesce("problem_text", F.lit("")), problem),
        F.lit("</problem>\n<resolution>"), snippet(F.col("resolution_text"), resolution), F.lit("</resolution>\n</item>"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pick", item.alias("b")))), lambda s: s["b"])
    return evidence.groupBy(*RUN_CLUSTER).agg(ordered.alias("items"))


def draft_prompts(gaps: DataFrame, evidence: DataFrame) -> DataFrame:
    """Prompts with five, three and no items of evidence; PARTIAL gaps show the known article.

    ``gaps`` may have kb_issue and kb_solution.
    """
    joined = gaps.join(evidence_block(evidence), list(RUN_CLUSTER), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    known = F.lit("")
    if "kb_solution" in gaps.columns:
        known = F.when(
            F.col("gap_flag") == "PARTIAL",
            F.concat(
                F.lit("\nThis article covers part of it; write only what it leaves out.\nTitle: "),
                F.coalesce("best_kb_title", F.lit("")), F.lit("\nIssue: "), snippet(F.coalesce("kb_issue", F.lit("")), 400),
                F.lit("\nSolution: "), snippet(F.coalesce("kb_solution", F.lit("")), 600), F.lit("\n"),
            ),
        ).otherwise("")

    def prompt(n: Column) -> Column:
        shown = F.slice(items, F.lit(1), n)
        return F.concat(
            F.lit("Write a help-desk article for this gap.\nTopic: "), F.col("cluster_label"),
            F.lit("\nTickets: "), F.format_number("size", 0), F.lit("\nTerms: "), F.coalesce("top_terms", F.lit("N/A")),
            F.lit("\nPriority: "), F.format_string("%.2f", F.col("priority_score").cast("double")), known,
            F.lit("\nEvidence:\n"),
            F.when(F.size(shown) > 0, F.array_join(shown, "\n")).otherwise("(none: write a general article)"),
            F.lit("\n\nReply with one JSON object: title, category, keywords, problem_statement, affected_systems, "
                  "resolution_steps, additional_notes, escalation_trigger, confidence."),
        )

    start = F.least(F.size(items), F.lit(5))
    tries = F.array_distinct(F.array(prompt(start), prompt(F.greatest(start - 2, F.lit(0))), prompt(F.lit(0))))
    return joined.select(*gaps.columns, tries.alias("prompts"))


def draft(prompts: DataFrame, chat_fn: ChatFn) -> DataFrame:
    """Gaps with the drafted article's fields; a reply that does not parse gives no row."""
    return parse_drafts(with_reply(prompts, F.col("prompts"), chat_fn).drop("prompts"))


def parse_drafts(replies: DataFrame) -> DataFrame:
    """Rows whose ``reply`` is an article with a title, with its fields as columns."""
    parsed = replies.withColumn("a", F.from_json("reply", ARTICLE_TYPE))
    return parsed.where(F.col("a.title").isNotNull()).drop("reply").select("*", "a.*").drop("a")


def assemble(drafted: DataFrame) -> DataFrame:
    """Article rows: score, issues, low-evidence rule, text to embed.

    ``drafted`` has the article fields with gap_flag and ev_quality.
    """
    parts = (F.col("resolution_steps"), F.col("problem_statement"), F.col("escalation_trigger"), F.col("confidence"))
    score, evidence = ar.quality_score(*parts), F.col("ev_quality")
    return drafted.select(
        *[c for c in drafted.columns if c not in ("additional_notes", "confidence", "ev_quality")],
        F.round("ev_quality", 3).alias("ev_quality"),
        score.alias("quality_score"),
        ar.issues_with_evidence(ar.quality_issues(*parts), evidence).alias("quality_issues"),
        ((score < 6) | ar.low_evidence(evidence)).alias("needs_review"),
        ar.notes_with_evidence(F.col("additional_notes"), evidence, F.col("gap_flag")).alias("additional_notes"),
        F.coalesce("confidence", F.lit(0.9)).alias("confidence"),
        ar.embedding_text(F.col("title"), F.col("problem_statement"), F.col("resolution_steps")).alias("embedding_text"),
    )


def embed_articles(assembled: DataFrame, embed_fn: EmbedFn) -> DataFrame:
    return with_vector(assembled, F.col("embedding_text"), embed_fn, "article_embedding").drop("embedding_text")


def list_order(articles: DataFrame) -> DataFrame:
    """``position`` in a run from 1: CRITICAL drafts first, by priority, then cluster id.

    Ids alone are ranked, range by range, so no run with its texts is one task's work.
    """
    first = F.when(F.col("gap_flag") == "CRITICAL", 0).otherwise(1)
    ids = articles.select("run_id", "cluster_id", "article_id", first.alias("__f"), (-F.col("priority_score")).alias("__p"))
    ranked = numbered(ids, ["run_id", "__f", "__p", "cluster_id", "article_id"], "__n")
    starts = ranked.groupBy("run_id").agg(F.min("__n").alias("__s"))
    places = ranked.join(starts, "run_id").select("run_id", "article_id", (F.col("__n") - F.col("__s") + 1).alias("position"))
    return articles.join(places, ["run_id", "article_id"])


def mark_duplicates(articles: DataFrame, bound: float = Thresholds.article_duplicate, **layout) -> DataFrame:
    """Articles with ``duplicate_of``: the cluster of the article each one repeats."""
    found = duplicate_articles(articles, bound=bound, **layout)
    return articles.join(found, list(RUN_CLUSTER), "left")


def resolve_duplicates(articles: DataFrame) -> DataFrame:
    """``is_duplicate_of``: the article id behind ``duplicate_of``."""
    ids = articles.select("run_id", F.col("cluster_id").alias("duplicate_of"), F.col("article_id").alias("is_duplicate_of"))
    return articles.drop("is_duplicate_of").join(ids, ["run_id", "duplicate_of"], "left")
