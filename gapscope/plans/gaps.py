"""Gap analysis: coverage and priority scores, duplicates, use of the articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapscope.config import SEED, Thresholds
from gapscope.functions.text import (
    duplicate_recommendation,
    gap_class,
    kb_status,
    recommendation,
    sanitise,
    snippet,
)
from gapscope.models import ChatFn, with_reply
from gapscope.operators.labelling import sample_members
from gapscope.operators.quantiles import similarity_percentile
from gapscope.operators.rounds import cut
from gapscope.operators.similarity import pairs_above

RUN = ("run_id",)
NONE: tuple[str, ...] = ()


def coverage_scores(
    matrix: DataFrame,
    n_articles: DataFrame | None = None,
    by: Sequence[str] = RUN,
    covered: float = Thresholds.covered,
    partial: float = Thresholds.partial,
) -> DataFrame:
    """Signals per cluster from the stored matrix ``(by.., cluster_id, kb_id, sim)``.

    Best article, mean of the top three, articles above the 75th percentile of the
    whole matrix, and the weighted coverage score. Best and top three come from one
    grouped pass with bounded state; nothing sorts the matrix.
    """
    by = list(by)
    key = [*by, "cluster_id"]
    best = F.struct((-F.col("sim")).alias("s"), F.col("kb_id").alias("i"))
    w = Window.partitionBy(*key).orderBy(F.desc("sim"), "kb_id")
    top3 = (
        matrix.select(*key, "kb_id", "sim").withColumn("__r", F.row_number().over(w)).where("__r <= 3")
        .groupBy(*key)
        .agg(F.avg("sim").alias("avg_top3_sim"), F.min_by("kb_id", best).alias("best_kb_id"), F.max("sim").alias("max_kb_sim"))
    )
    bound = similarity_percentile(matrix, "sim", 0.75, by, "p75")
    marked = _join_bound(matrix, bound, by)
    breadth = marked.groupBy(*key).agg(
        F.count_if(F.col("sim") > F.col("p75")).alias("n_above_p75"), F.count("*").alias("n_kb")
    )
    score = (
        0.5 * F.col("max_kb_sim") + 0.3 * F.col("avg_top3_sim") + 0.2 * (F.col("n_above_p75") / F.col("n_kb"))
    )
    return top3.join(breadth, key).select(
        *key, "best_kb_id", "max_kb_sim", "avg_top3_sim", "n_above_p75", score.alias("coverage_score"),
        gap_class(F.col("max_kb_sim"), covered, partial).alias("gap_flag"),
    )


def _join_bound(matrix: DataFrame, bound: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the percentile of their run; a single bound is a scalar, not a join."""
    return matrix.join(bound, list(by)) if by else matrix.withColumn("p75", bound.select("p75").scalar())


def tier_weight(tier: Column, weights: Sequence[float] = Thresholds.tier_weights) -> Column:
    tier = F.coalesce(tier, F.lit(4))
    out = F.when(tier == 1, weights[0])
    for i, w in enumerate(weights[1:], 2):
        out = out.when(tier == i, w)
    return out.otherwise(0.0)


def evidence_quality(assignments: DataFrame, rows: DataFrame) -> DataFrame:
    """Mean tier weight per cluster; a ticket without vectors counts as tier 4."""
    tiers = rows.select("run_id", "source", "source_id", "evidence_tier")
    joined = assignments.join(tiers, ["run_id", "source", "source_id"], "left")
    return joined.groupBy("run_id", "cluster_id").agg(
        F.round(F.avg(tier_weight(F.col("evidence_tier"))), 4).alias("evidence_quality")
    )


def recent_counts(assignments: DataFrame, incidents: DataFrame, as_of, days: int = 90) -> DataFrame:
    """Incident tickets per cluster reported in the last ``days`` before ``as_of``."""
    dates = incidents.select(F.col("id").alias("source_id"), "reported_date")
    joined = assignments.where("source = 'incident'").join(dates, "source_id")
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return joined.groupBy("run_id", "cluster_id").agg(
        F.count_if(F.col("reported_date") >= since).alias("recent_count")
    )


def min_max(df: DataFrame, columns: Sequence[str], by: Sequence[str] = RUN) -> DataFrame:
    """``<c>_scaled`` in 0..1 within each run; a constant column scales to 0.

    Bounds come from a grouped aggregate joined back, so no run sits in one task.
    """
    by = list(by)
    bounds = df.groupBy(*by).agg(
        *[F.min(c).alias(f"__lo_{c}") for c in columns], *[F.max(c).alias(f"__hi_{c}") for c in columns]
    )
    joined = df.join(bounds, by)
    for c in columns:
        span = F.col(f"__hi_{c}") - F.col(f"__lo_{c}")
        scaled = (F.col(c) - F.col(f"__lo_{c}")) / F.nullif(span.cast("double"), F.lit(0.0))
        joined = joined.withColumn(f"{c}_scaled", F.coalesce(scaled, F.lit(0.0)))
    return joined.drop(*[f"__{e}_{c}" for c in columns for e in ("lo", "hi")])


def priorities(
    signals: DataFrame, by: Sequence[str] = RUN, weights: dict[str, float] | None = None
) -> DataFrame:
    """``priority_score`` from size, recent_count, coverage_score and evidence_quality."""
    w = weights or Thresholds().priority_weights
    by = list(by)
    # Bounds and maxima each read the signals again: a row per cluster, stored once.
    filled = cut(signals.fillna(0, ["recent_count", "evidence_quality"]))
    scaled = min_max(filled, ["size", "recent_count", "coverage_score", "evidence_quality"], by)
    raw = scaled.withColumn(
        "__raw",
        w["volume"] * F.col("size_scaled") + w["recency"] * F.col("recent_count_scaled")
        + w["gap"] * (1.0 - F.col("coverage_score_scaled")) + w["evidence"] * F.col("evidence_quality_scaled"),
    )
    raw = cut(raw)
    top = raw.groupBy(*by).agg(F.greatest(F.max("__raw"), F.lit(1e-9)).alias("__top"))
    return raw.join(top, by).withColumn("priority_score", F.col("__raw") / F.col("__top")).drop(
        "__raw", "__top", "size_scaled", "recent_count_scaled", "coverage_score_scaled", "evidence_quality_scaled"
    )


def duplicate_candidates(
    clusters: DataFrame, bound: float = Thresholds.duplicate_candidate, by: Sequence[str] = RUN, **layout
) -> DataFrame:
    """Pairs of CRITICAL clusters of a run with close centroids."""
    critical = clusters.where("gap_flag = 'CRITICAL'")
    return pairs_above(critical, "cluster_id", "centroid", bound, by=by, **layout)


def pair_prompts(pairs: DataFrame, clusters: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """One prompt per candidate pair: label, terms, summary of both sides."""
    by = list(by)

    def side(name: str) -> DataFrame:
        text = F.concat(
            F.lit(f"CLUSTER {name.upper()} (ID="), F.col("cluster_id").cast("string"), F.lit(", "),
            F.col("size").cast("string"), F.lit(" tickets)\nLabel: "), F.col("cluster_label"),
            F.lit("\nTerms: "), F.coalesce("top_terms", F.lit("")),
            F.lit("\nSummary: "), snippet(F.coalesce("summary", F.lit("")), 600),
        )
        return clusters.select(*by, F.col("cluster_id").alias(name), text.alias(f"text_{name}"))

    joined = pairs.join(side("a"), [*by, "a"]).join(side("b"), [*by, "b"])
    prompt = F.concat(
        F.lit("Would one and the same article settle the tickets of both clusters?\n\n"),
        F.col("text_a"), F.lit("\n\n"), F.col("text_b"),
        F.lit("\n\nSimilarity: "), F.format_string("%.4f", "sim"),
        F.lit('\nReply with JSON: {"is_duplicate": bool, "confidence": "HIGH|MEDIUM|LOW", "reason": "..."}'),
    )
    return joined.select(*by, "a", "b", "sim", prompt.alias("prompt"))


def accepted_pairs(prompts: DataFrame, chat_fn: ChatFn) -> DataFrame:
    """Pairs the model calls duplicates with HIGH confidence."""
    return accept(with_reply(prompts, F.array("prompt"), chat_fn).drop("prompt"))


def accept(replied: DataFrame) -> DataFrame:
    """Rows whose ``reply`` is sure of a duplicate, with its reason."""
    decided = replied.withColumn("r", F.from_json("reply", "is_duplicate boolean, confidence string, reason string"))
    sure = F.coalesce(F.col("r.is_duplicate") & (F.upper("r.confidence") == "HIGH"), F.lit(False))
    return decided.where(sure).withColumn("reason", F.coalesce("r.reason", F.lit(""))).drop("r", "reply")


def gap_report(scored: DataFrame, articles: DataFrame, merges: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Rows as stored: four decimals, recommendation, DUPLICATE where merged away."""
    by = list(by)
    titles = articles.select(F.col("kb_id").alias("best_kb_id"), F.col("title").alias("best_kb_title"))
    joined = scored.join(titles, "best_kb_id", "left").join(merges, [*by, "cluster_id"], "left")
    merged = F.col("merged_into").isNotNull()
    return joined.select(
        *by, "cluster_id", "cluster_label", "size",
        F.round("max_kb_sim", 4).alias("max_kb_sim"), F.round("avg_top3_sim", 4).alias("avg_top3_sim"),
        "n_above_p75", F.round("coverage_score", 4).alias("coverage_score"),
        F.round("priority_score", 4).alias("priority_score"),
        F.when(merged, "DUPLICATE").otherwise(F.col("gap_flag")).alias("gap_flag"),
        F.when(merged, duplicate_recommendation(F.col("merged_into"), F.col("reason"))).otherwise(
            recommendation(F.col("gap_flag"), F.col("cluster_label"), F.col("best_kb_title"))
        ).alias("recommendation"),
        "best_kb_id", "best_kb_title", "merged_into",
    )


def flag_counts(table: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    return table.groupBy(*by, "gap_flag").agg(F.count("*").alias("clusters"))


def kb_utilization(
    matrix: DataFrame,
    scored: DataFrame,
    by: Sequence[str] = RUN,
    partial: float = Thresholds.partial,
    over_relied: int = Thresholds.over_relied,
) -> DataFrame:
    """How each article is used: best for how many clusters, similarity, breadth, status."""
    by = list(by)
    key = [*by, "kb_id"]
    marked = _join_bound(matrix, similarity_percentile(matrix, "sim", 0.75, by, "p75"), by)
    use = marked.groupBy(*key).agg(
        F.max("sim").alias("__max"), F.avg("sim").alias("__mean"),
        F.count_if(F.col("sim") > F.col("p75")).alias("breadth_count"),
    )
    best = scored.groupBy(*by, F.col("best_kb_id").alias("kb_id")).agg(F.count("*").alias("clusters_as_best"))
    joined = use.join(best, key, "left").fillna(0, ["clusters_as_best"])
    max_sim = F.round("__max", 4)
    return joined.select(
        *key, "clusters_as_best", max_sim.alias("max_cluster_sim"), F.round("__mean", 4).alias("mean_cluster_sim"),
        "breadth_count", kb_status(F.col("clusters_as_best"), max_sim, partial, over_relied).alias("status"),
    )


def summary_samples(members: DataFrame, n: int = 20, chars: int = 300, seed: int = SEED) -> DataFrame:
    """Sanitised snippets of up to ``n`` members per cluster, in draw order.

    ``members`` has run_id, cluster_id, source, source_id and problem_text. Ids are
    drawn first; texts join the few that were drawn.
    """
    key = ["source", "source_id"]
    long_enough = members.where(F.length("problem_text") > 20).select("run_id", "cluster_id", *key)
    picked = sample_members(long_enough, ["run_id", "cluster_id"], key, n, seed)
    texts = members.select("run_id", *key, "problem_text")
    # Filtering inside the array keeps Spark from sanitising a text once to test it and
    # once more to return it.
    clean = F.filter(F.array(snippet(sanitise(F.col("problem_text")), chars)), lambda s: F.length(s) > 20)
    rows = picked.join(texts, ["run_id", *key]).select(
        "run_id", "cluster_id", "pick", F.explode_outer(clean).alias("snippet")
    )
    return rows.where(F.col("snippet").isNotNull())


def summary_prompts(clusters: DataFrame, samples: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Prompts of falling sample size (all, half, a quarter, at least five) per cluster."""
    key = [*by, "cluster_id"]
    listed = samples.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pick", "snippet"))), lambda s: s["snippet"]).alias("__s")
    )
    joined = clusters.join(listed, key)

    def prompt(n: Column) -> Column:
        shown = F.transform(
            F.slice("__s", F.lit(1), n), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)
        )
        return F.concat(
            F.lit("Summarise this cluster of support tickets in five labelled sections: problem type, "
                  "affected users, systems and tools, failure patterns, typical resolution.\nTickets: "),
            F.col("size").cast("string"), F.lit("\nGap status: "), F.col("gap_flag"),
            F.lit("\nTerms: "), F.coalesce("top_terms", F.lit("")), F.lit("\nSamples:\n"), F.array_join(shown, "\n"),
        )

    size = F.size("__s")
    fewer = lambda c: F.when(c > 5, F.greatest(F.lit(5), F.floor(c / 2))).otherwise(c).cast("int")
    tries = F.array_distinct(F.array(prompt(size), prompt(fewer(size)), prompt(fewer(fewer(size)))))
    return joined.select(*key, tries.alias("prompts"))


def summaries(prompts: DataFrame, chat_fn: ChatFn, by: Sequence[str] = RUN) -> DataFrame:
    return with_reply(prompts, F.col("prompts"), chat_fn, "summary").select(*by, "cluster_id", "summary").where("summary <> ''")
