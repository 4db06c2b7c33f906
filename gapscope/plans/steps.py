"""The six steps of a run. Each takes tables and gives back tables to store.

Steps hand over through stored tables only, so each can be run again by itself:
``store`` replaces the run's partition of every table a step returns, and drops it from
those that the step fills but returned nothing for (``FILLS``).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscope.config import Thresholds
from gapscope.models import ChatFn, EmbedFn
from gapscope.operators import clustering as cl
from gapscope.operators import labelling as lb
from gapscope.operators import merging as mg
from gapscope.operators import minibatch as mb
from gapscope.operators.rounds import cut, numbered
from gapscope.operators.similarity import Side, full_matrix
from gapscope.plans import counts
from gapscope.plans import coverage as cv
from gapscope.plans import drafting as dr
from gapscope.plans import gaps as gp
from gapscope.plans import preprocess as pp
from gapscope.plans import review as rv
from gapscope.plans import validation as va
from gapscope.sources import sinks as sk
from gapscope.sources import tables as tb

Frames = Mapping[str, DataFrame]
#: Tables whose rows of a run a step replaces as a whole, returned or not.
FILLS = {
    "preprocess": ("ticket_embeddings",),
    "clustering": sk.CLUSTER_STEP_TABLES,
}


def articles_of(tables: Frames) -> DataFrame:
    """Existing articles as kb_id, kb_idx, title, issue, solution, kb_vec."""
    kb = tb.kb_articles(tables["knowledge_base_articles"]).withColumnRenamed("id", "kb_id")
    return kb.join(numbered(kb.select("kb_id"), ["kb_id"], "kb_idx"), "kb_id")


def preprocess(tables: Frames, run_id: str, embed_fn: EmbedFn, t: Thresholds = Thresholds()) -> dict[str, DataFrame]:
    inc = tables["incidents_processed"]
    for c in ("e_description", "e_detailed_description", "e_resolution_summary"):
        inc = inc.withColumn(c, tb._vector(inc, c))
    wo = tables["workorders_processed"]
    for c in ("e_description", "e_activity_logs"):
        wo = wo.withColumn(c, tb._vector(wo, c))
    judged_inc = pp.judge_incidents(pp.incident_features(inc), t)
    cleaned = pp.embed_workorders(pp.clean_workorders(wo, t), embed_fn)
    judged_wo = pp.judge_workorders(pp.workorder_features(cleaned, t), t)
    return {
        "ticket_embeddings": pp.embeddings_table(judged_inc, "incident", run_id).unionByName(
            pp.embeddings_table(judged_wo, "workorder", run_id)
        )
    }


def clustering(
    tables: Frames,
    run_id: str,
    t: Thresholds = Thresholds(),
    *,
    best_k: int | None = None,
    chat_fn: ChatFn | None = None,
    stop_words: list[str] | None = None,
    min_docs: int = 5,
    tries: int = 5,
    final_tries: int = 15,
) -> dict[str, DataFrame]:
    tickets = tb.unified_tickets(tables["incidents_processed"], tables["workorders_processed"])
    held = cut(cv.working_vectors(tb.run_tickets(tables["ticket_embeddings"], tickets, run_id)).withColumn(
        "ticket_id", F.concat_ws(":", "source", "source_id")
    ))
    kb = cut(articles_of(tables))
    key = ("ticket_id", "source", "source_id")
    out = {"ticket_coverage": cv.ticket_coverage(held, kb, key, t.covered, t.partial).drop("ticket_id")}
    out["ticket_coverage"] = out["ticket_coverage"].withColumn("run_id", F.lit(run_id))
    if not cl.enough_tickets(held, t.min_cluster_tickets):
        return out
    if best_k is None:
        swept = cut(cl.choose_k(mb.sweep(held, "ticket_id", "cluster_vec", t.k_values, tries=tries)))
        out["cluster_sweep"] = sk.sweep_rows(swept.withColumn("run_id", F.lit(run_id)))
        best_k = swept.where("is_best_k").first()["k"]
    first = cut(mb.kmeans(held, "ticket_id", "cluster_vec", best_k, tries=final_tries).withColumn("cluster_id", F.col("cluster_id").cast("long")))
    grouped = cut(cl.split_oversize(first, "ticket_id", "cluster_vec", floor=t.split_floor, target=t.split_target))
    summary = cut(cv.cluster_summary(grouped, kb, ("cluster_id",), t.covered, t.partial))

    stops = stop_words if stop_words is not None else lb.english_stop_words(held.sparkSession)
    counts = lb.term_counts(grouped, "ticket_id", "problem_text", "resolution_text", stops)
    weights = lb.tfidf(counts, lb.vocabulary(counts, grouped, min_docs=min_docs), "ticket_id")
    named = summary.join(lb.labels(lb.cluster_terms(weights, grouped), grouped), "cluster_id")
    if chat_fn is not None:
        named = cut(named)
        samples = cv.label_samples(grouped.drop("run_id"))
        named = cv.model_labels(named, cv.label_prompts(named, samples), chat_fn)
    named = cut(cl.project_2d(named))
    quality = cl.squared_silhouette(grouped, "ticket_id", "cluster_vec").agg(F.avg("silhouette")).scalar()
    out["clusters"] = named.withColumn("run_id", F.lit(run_id)).withColumn("silhouette", quality).withColumn(
        "summary", F.lit(None).cast("string")
    ).withColumn("threshold_partial", F.lit(t.partial)).withColumn("threshold_covered", F.lit(t.covered))
    labels = named.select("cluster_id", "cluster_label")
    out["cluster_assignments"] = grouped.join(labels, "cluster_id").select(
        "source", "source_id", F.lit(run_id).alias("run_id"), "cluster_id", "cluster_label",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("service_type", "assigned_group", "ticket_number")],
    )
    matrix = full_matrix(Side(named, "kb_centroid", ["cluster_id"]), Side(kb.withColumnRenamed("title", "kb_title"), "kb_vec", ["kb_idx", "kb_title"]))
    out["cluster_kb_sim"] = sk.matrix_rows(matrix.withColumn("run_id", F.lit(run_id)))
    return out


def gap_analysis(
    tables: Frames,
    run_id: str,
    as_of,
    t: Thresholds = Thresholds(),
    *,
    chat_fn: ChatFn | None = None,
    centroid: str = "centroid",
) -> dict[str, DataFrame]:
    """``centroid`` names the centroid compared with articles: blended, or ``kb_centroid``."""
    clusters = tb.of_run(tables["clusters"], run_id)
    assignments = tb.of_run(tables["cluster_assignments"], run_id)
    tickets = tb.unified_tickets(tables["incidents_processed"], tables["workorders_processed"])
    kb = cut(articles_of(tables))
    left = Side(clusters, centroid, ["cluster_id"])
    matrix = cut(full_matrix(left, Side(kb, "kb_vec", ["kb_id"])).withColumn("run_id", F.lit(run_id)))
    scored = gp.coverage_scores(matrix, covered=t.covered, partial=t.partial)
    base = clusters.select("run_id", "cluster_id", "cluster_label", "size", "top_terms", "centroid")
    key = ["run_id", "cluster_id"]
    # A cluster that met no article is as uncovered as can be.
    met = base.join(scored, key, "left").fillna(0, ["max_kb_sim", "avg_top3_sim", "n_above_p75", "coverage_score"]).fillna("CRITICAL", ["gap_flag"])
    signals = (
        met.join(gp.recent_counts(assignments, tables["incidents_processed"], as_of), key, "left")
        .join(gp.evidence_quality(assignments, tb.of_run(tables["ticket_embeddings"], run_id)), key, "left")
    )
    ranked = cut(gp.priorities(signals, weights=t.priority_weights))
    merges = base.select(*key, F.lit(None).cast("long").alias("merged_into"), F.lit("").alias("reason")).limit(0)
    if chat_fn is not None:
        # Summaries come first, so that the question about duplicates can show them.
        members = assignments.join(tickets.select("source", "source_id", "problem_text"), ["source", "source_id"])
        asked = gp.summary_prompts(ranked, gp.summary_samples(members))
        ranked = cut(ranked.join(gp.summaries(asked, chat_fn), key, "left"))
        decide = lambda pairs: gp.accepted_pairs(gp.pair_prompts(pairs, ranked), chat_fn)
        merges = mg.merge_by_asking(ranked.where("gap_flag = 'CRITICAL'"), decide, t.duplicate_candidate)
    else:
        ranked = ranked.withColumn("summary", F.lit(None).cast("string"))
    ends = mg.resolve_chains(merges)
    report = gp.gap_report(ranked, kb, merges)
    report = mg.repair_priority(report, ends, t.priority_weights["volume"])
    moved = mg.move_tickets(assignments, ends, clusters)
    flags = clusters.drop("summary").join(ranked.select(*key, "summary"), key)
    use = gp.kb_utilization(matrix, scored, partial=t.partial, over_relied=t.over_relied)
    index = sk.existing_entries(kb.withColumnRenamed("kb_id", "id"), clusters.select("run_id"))
    if "kb_search_index" in tables:  # generated entries of an earlier pass stay
        index = sk.upsert_table("kb_search_index", tb.of_run(tables["kb_search_index"], run_id), index)
    top = base.select(*key, "top_terms")
    return {
        "clusters": mg.merge_clusters(flags, moved, ends),
        "cluster_assignments": moved,
        "gap_analysis": report.join(top, key),
        "kb_utilization": use.join(kb.select("kb_id", "kb_idx", "title"), "kb_id"),
        "kb_search_index": index,
    }


def review(tables: Frames, run_id: str, chat_fn: ChatFn, counted: dict[str, dict[str, int]] | None = None) -> dict[str, DataFrame]:
    """``counted`` takes the counters of the opinions, under that name."""
    clusters = tb.of_run(tables["clusters"], run_id)
    critical = tb.critical_with_summary(clusters)
    found = rv.candidates(critical, articles_of(tables))
    answers, seen = counts.watched(rv.asked(critical, rv.opinions(rv.candidate_prompts(critical, found), chat_fn)), counts.opinions())
    answers = cut(answers)
    if counted is not None:
        counted["opinions"] = seen.get
    opinions = answers.where("answered").drop("answered")
    return {
        "clusters": rv.override_flags(rv.store_opinions(clusters, opinions), opinions),
        "gap_analysis": rv.override_flags(tb.of_run(tables["gap_analysis"], run_id), opinions),
    }


def drafting(
    tables: Frames, run_id: str, chat_fn: ChatFn, embed_fn: EmbedFn, t: Thresholds = Thresholds()
) -> dict[str, DataFrame]:
    gaps = tb.of_run(tables["gap_analysis"], run_id)
    assignments = tb.of_run(tables["cluster_assignments"], run_id)
    tickets = tb.unified_tickets(tables["incidents_processed"], tables["workorders_processed"])
    evidence = cut(dr.cluster_evidence(assignments, tickets, tb.of_run(tables["ticket_embeddings"], run_id)))
    partial = dr.partial_gaps(gaps, articles_of(tables))
    critical = dr.critical_gaps(gaps, assignments).drop("service_type")
    todo = critical.unionByName(partial, allowMissingColumns=True)
    prompts = dr.draft_prompts(dr.evidence_scores(todo, evidence), evidence)
    drafted = cut(dr.draft(prompts, chat_fn))
    assembled = dr.embed_articles(dr.assemble(drafted), embed_fn).withColumn(
        "article_id", F.md5(F.concat_ws("|", "run_id", F.col("cluster_id").cast("string")))
    )
    ordered = cut(dr.list_order(assembled))
    articles = dr.resolve_duplicates(dr.mark_duplicates(ordered, t.article_duplicate)).drop("position", "kb_issue", "kb_solution")
    index = sk.replace_generated(tb.of_run(tables["kb_search_index"], run_id), ordered)
    out = {"generated_kb_articles": articles, "kb_search_index": index}
    if "kb_validation_results" in tables and "generated_kb_articles" in tables:
        # Results about articles that are replaced go with them.
        gone = tb.of_run(tables["generated_kb_articles"], run_id)
        out["kb_validation_results"] = sk.replace_articles(gone, tb.of_run(tables["kb_validation_results"], run_id), gone)[1]
    return out


def validation(
    tables: Frames, run_id: str, chat_fn: ChatFn, t: Thresholds = Thresholds()
) -> dict[str, DataFrame]:
    articles = tb.of_run(tables["generated_kb_articles"], run_id)
    live = tb.live_articles(articles)
    assignments = tb.of_run(tables["cluster_assignments"], run_id)
    tickets = tb.unified_tickets(tables["incidents_processed"], tables["workorders_processed"])
    evidence = cut(dr.cluster_evidence(assignments, tickets, tb.of_run(tables["ticket_embeddings"], run_id), n=3))
    critiqued = cut(va.critiques(va.critique_prompts(live, evidence), chat_fn))
    index = tb.of_run(tables["kb_search_index"], run_id).where(~F.col("is_generated"))
    existing = index.select("run_id", F.col("source_id").alias("kb_id"), F.col("title").alias("kb_title"), F.col("embedding").alias("kb_vec"))
    centroids = tb.of_run(tables["clusters"], run_id, "run_id", "cluster_id", "centroid")
    rows = cut(va.validation_rows(live, existing, centroids, critiqued, t))
    metrics = va.scorecard(rows)
    if "evaluation_results" in tables:  # those of other categories stay
        metrics = sk.replace_metrics(tb.of_run(tables["evaluation_results"], run_id), metrics)
    return {
        "kb_validation_results": rows,
        "evaluation_results": metrics,
        "generated_kb_articles": sk.flag_for_review(articles, va.to_review(rows)),
    }


def store(outputs: Frames, folder: str, run_id: str | None = None, step: str | None = None) -> dict[str, dict[str, int]]:
    """Put every table of a step into its place; gives back the counters of those that have some.

    All are written beside their places before any is moved, so results may read the tables
    they replace, and a step that fails while writing or moving changes nothing. With ``run_id`` the
    run is replaced even where a table has no rows for it, and ``step`` names the step whose
    other tables of that run are dropped.
    """
    runs = None if run_id is None else [run_id]
    spark = next(iter(outputs.values())).sparkSession
    staged, seen = {}, {}
    for name, df in outputs.items():
        if counters := counts.of_table(name):
            df, seen[name] = counts.watched(df, counters)
        staged[name] = sk.stage(df, f"{folder}/{name}")
    emptied = [name for name in FILLS.get(step, ()) if name not in staged] if runs else []
    sk.put_all(spark, [(None, f"{folder}/{name}", runs) for name in emptied] + [(at, f"{folder}/{name}", runs) for name, at in staged.items()])
    return {name: counters.get for name, counters in seen.items()}
