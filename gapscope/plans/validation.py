"""Validation of drafts: critique, novelty, alignment, verdict, scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscope.config import Thresholds
from gapscope.functions import article_rules as ar
from gapscope.models import ChatFn, with_reply
from gapscope.operators.similarity import Side, alignment, novelty
from gapscope.plans.drafting import RUN_CLUSTER, evidence_block

CRITIQUE_TYPE = (
    "coverage_score double, gap_confirmed boolean, missing_elements array<string>, verdict string, critique string"
)
FALLBACK_TEXT = "LLM critique unavailable — embedding-only fallback used."


def critique_prompts(articles: DataFrame, evidence: DataFrame) -> DataFrame:
    """Prompt per draft with its evidence; supplements are judged as supplements."""
    items = evidence_block(evidence, problem=350, resolution=500)
    joined = articles.join(items, list(RUN_CLUSTER), "left")
    supplement = F.col("gap_flag") == "PARTIAL"
    note = F.when(
        supplement, "The article supplements a known one; overlap is expected. Judge only what it adds."
    ).otherwise("No known article covers this topic. Judge whether the draft settles it.")
    rule = F.when(
        supplement, "VALIDATED from 7 on, PARTIAL from 4 to 6, INSUFFICIENT below 4"
    ).otherwise("VALIDATED from 7 on with gap_confirmed, PARTIAL from 4 to 6, INSUFFICIENT below 4")
    shown = F.when(F.size("items") > 0, F.array_join("items", "\n")).otherwise("(no ticket evidence available)")
    prompt = F.concat(
        note, F.lit("\n\nTitle: "), F.coalesce("title", F.lit("")), F.lit("\nProblem: "),
        F.coalesce("problem_statement", F.lit("")), F.lit("\nSteps:\n"), F.coalesce(F.array_join("resolution_steps", "\n"), F.lit("")),
        F.lit("\nEscalation: "), F.coalesce("escalation_trigger", F.lit("")), F.lit("\n\nEvidence:\n"), shown,
        F.lit("\n\nVerdict rule: "), rule,
        F.lit("\nReply with one JSON object: coverage_score, gap_confirmed, missing_elements, verdict, critique."),
    )
    return joined.select("run_id", "article_id", prompt.alias("prompt"))


def critiques(prompts: DataFrame, chat_fn: ChatFn) -> DataFrame:
    """Replies with defaults for missing fields; no row where the call failed."""
    asked = with_reply(prompts, F.array("prompt"), chat_fn)
    return normalise_critiques(asked.select("run_id", "article_id", "reply"))


def normalise_critiques(replies: DataFrame) -> DataFrame:
    parsed = replies.withColumn("m", F.from_json("reply", "map<string,string>")).where(F.col("m").isNotNull())
    r = parsed.withColumn("r", F.from_json("reply", CRITIQUE_TYPE))
    return r.select(
        "run_id", "article_id",
        F.coalesce("r.coverage_score", F.lit(5.0)).alias("coverage_score"),
        F.coalesce("r.gap_confirmed", F.lit(True)).alias("gap_confirmed"),
        F.coalesce("r.missing_elements", F.array().cast("array<string>")).alias("missing_elements"),
        ar.normalise_verdict(F.col("r.verdict")).alias("verdict"),
        F.coalesce("r.critique", F.lit("")).alias("critique"),
    )


def validation_rows(
    articles: DataFrame,
    existing: DataFrame,
    centroids: DataFrame,
    critiqued: DataFrame,
    t: Thresholds = Thresholds(),
    **layout,
) -> DataFrame:
    """One row per draft with all signals and the final status; joins only, no loop.

    ``existing`` has run_id, kb_id, kb_title, kb_vec; ``centroids`` run_id, cluster_id, centroid.
    """
    fresh = novelty(
        Side(articles, "article_embedding", ["article_id", "cluster_id", "gap_flag"]),
        Side(existing, "kb_vec", ["kb_id", "kb_title"]),
        "gap_flag", by=["run_id"], critical=t.novelty_critical, other=t.novelty_other, **layout,
    )
    near = alignment(articles, centroids, RUN_CLUSTER, "article_embedding", "centroid", t.alignment).select(
        "run_id", "article_id", "alignment_score", "alignment_pass"
    )
    c = critiqued.select(
        "run_id", "article_id", "coverage_score", "gap_confirmed", "missing_elements", "verdict", "critique"
    )
    joined = fresh.join(near, ["run_id", "article_id"]).join(c, ["run_id", "article_id"], "left")
    failed = F.col("verdict").isNull()
    verdict = F.when(failed, ar.fallback_verdict(F.col("alignment_pass"))).otherwise(F.col("verdict"))
    rows = joined.withColumn("__v", verdict)
    return rows.select(
        "run_id", "article_id", "cluster_id", "gap_flag",
        F.col("coverage_score").alias("review_coverage_score"),
        F.when(failed, F.col("novelty_pass")).otherwise(F.col("gap_confirmed")).alias("review_gap_confirmed"),
        F.col("__v").alias("review_verdict"),
        F.when(failed, FALLBACK_TEXT).otherwise(F.col("critique")).alias("review_critique"),
        F.coalesce("missing_elements", F.array().cast("array<string>")).alias("review_missing_elements"),
        failed.alias("review_fallback"),
        F.round("max_existing_kb_sim", 4).alias("max_existing_kb_sim"), "closest_existing_kb",
        F.round("alignment_score", 4).alias("cluster_alignment_score"),
        "novelty_pass", "alignment_pass",
        ar.final_verdict(F.col("__v"), F.col("novelty_pass"), F.col("alignment_pass"), F.col("gap_flag")).alias("validation_status"),
    )


def scorecard(rows: DataFrame) -> DataFrame:
    """Six metrics per run with target and status, from one aggregate."""
    status = F.col("validation_status")
    a = rows.groupBy("run_id").agg(
        F.count("*").alias("n"),
        F.count_if(status == "VALIDATED").alias("ok"), F.count_if(status == "PARTIAL").alias("part"),
        F.count_if(status == "FAIL").alias("bad"), F.count_if("novelty_pass").alias("new"),
        F.coalesce(F.avg("review_coverage_score"), F.lit(0.0)).alias("score"),
        F.coalesce(F.avg("cluster_alignment_score"), F.lit(0.0)).alias("near"),
    )
    share = lambda c: F.col(c) / F.col("n") * 100
    of = lambda c: F.format_string("%d/%d (%.0f%%)", F.col(c), F.col("n"), F.bround(share(c), 0))
    grade = lambda test, miss: F.when(test, "Pass ✅").otherwise(miss)
    fail, warn = "Fail ❌", "Warn ⚠"
    metrics = (
        ("Articles fully validated (VALIDATED)", of("ok"), "> 70%", grade(share("ok") >= 70, fail)),
        ("Articles partially valid (PARTIAL)", of("part"), "—", F.lit("Info")),
        ("Articles failed validation (FAIL)", of("bad"), "< 10%", grade(share("bad") < 10, fail)),
        ("Mean LLM coverage score (0-10)", F.concat(_fixed("score", 1), F.lit("/10")), "> 6.0", grade(F.col("score") >= 6.0, fail)),
        ("Articles with gap novelty confirmed", of("new"), "> 80%", grade(share("new") >= 80, warn)),
        ("Mean cluster alignment score", _fixed("near", 3), "> 0.75", grade(F.col("near") >= 0.75, warn)),
    )
    stacked = F.explode(
        F.array(*[
            F.struct(F.lit(i).alias("place"), F.lit(m).alias("metric"), r.alias("result"), F.lit(t).alias("target"), s.alias("status"))
            for i, (m, r, t, s) in enumerate(metrics, 1)
        ])
    )
    return a.select("run_id", stacked.alias("m")).select("run_id", "m.*", F.lit("validation").alias("category"))


def _fixed(c: str, digits: int):
    return F.format_string(f"%.{digits}f", F.bround(c, digits))


def to_review(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("validation_status").isin("PARTIAL", "FAIL")).select("run_id", "article_id")
