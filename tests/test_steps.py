"""All six steps in order on the small tables, stored and read back between steps."""

import json
import sys
from dataclasses import replace
from glob import glob

from pyspark import cloudpickle
from pyspark.sql import functions as F

from gapscope.config import Thresholds
from gapscope.plans import steps
from gapscope.queries.roles import STOP_WORDS, Tables
from gapscope.sources.sinks import RUN_TABLES, drop_run
from tests.standins import hashed_bag_of_words

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import this file

LIMITS = replace(
    Thresholds(), covered=0.5, partial=0.4, duplicate_candidate=-1.0, article_duplicate=0.95, novelty_critical=0.9, novelty_other=0.97,
    alignment=-1.0, k_values=(3, 5, 8), split_floor=60, split_target=40, min_activity_words=5, min_clean_words=5,
)


def chat(prompt):
    if "one and the same article" in prompt:
        return json.dumps({"is_duplicate": "Similarity: 0.0" not in prompt, "confidence": "HIGH", "reason": "alike"})
    if "five labelled sections" in prompt:
        return "**Problem Type:** " + prompt[-20:]
    if "one of the candidates" in prompt:
        hit = "Cluster" in prompt
        return json.dumps({"match_found": hit, "matched_kb_id": "1", "matched_kb_title": "Known", "confidence": "LOW", "reasoning": "x"})
    if "help-desk article" in prompt:
        return json.dumps({
            "title": prompt[50:90], "category": "Other", "keywords": ["a"], "problem_statement": prompt[:80], "affected_systems": [],
            "resolution_steps": ["one", "two", "three"], "additional_notes": "n", "escalation_trigger": "desk", "confidence": 0.9,
        })
    if "Verdict rule" in prompt:
        return json.dumps({"coverage_score": 8, "gap_confirmed": True, "missing_elements": [], "verdict": "VALIDATED", "critique": "fine"})
    return json.dumps({"label": "A Usable Label"})


def sources(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    common = lambda df: df.withColumn("ticket_number", F.concat(F.lit("T"), "id")).withColumn("service_type", F.lit("Mail")).withColumn("assigned_group", F.lit("Desk"))
    inc = common(t.incident_inputs()).withColumn("reported_date", F.to_timestamp(F.lit("2024-01-01")))
    wo = common(t.workorder_inputs()).withColumn("description", F.lit("short title")).drop("e_clean")
    kb = t.kb().select(
        F.col("kb_id").cast("string").alias("id"), "title", "issue", "solution", F.to_json("kb_vec").alias("e_title"), F.lit(None).cast("string").alias("e_solution")
    )
    return {"incidents_processed": inc, "workorders_processed": wo, "knowledge_base_articles": kb}


def test_all_steps(spark, tmp_path):
    folder = str(tmp_path)
    given = sources(spark)
    stored = {}

    def keep(out, step=None):
        steps.store(out, folder, "run1", step)
        for name in out:
            if not glob(f"{folder}/{name}/run_id=*"):  # no rows are left
                stored.pop(name, None)
                continue
            stored[name] = spark.read.parquet(f"{folder}/{name}").withColumn("run_id", F.col("run_id").cast("string"))

    def tables():
        return {**given, **stored}

    keep(steps.preprocess(tables(), "run1", hashed_bag_of_words(), LIMITS), "preprocess")
    te = stored["ticket_embeddings"]
    assert te.count() == 200 + 87 and te.where("quality_pass").count() > 150
    assert te.where("quality_pass AND (problem_vec IS NULL OR res_vec IS NULL)").isEmpty()

    keep(steps.clustering(tables(), "run1", LIMITS, chat_fn=chat, stop_words=list(STOP_WORDS), tries=1, final_tries=2), "clustering")
    passed = te.where("quality_pass").count()
    assert stored["ticket_coverage"].count() == passed == stored["cluster_assignments"].count()
    clusters = stored["clusters"].collect()
    assert sorted(c["cluster_id"] for c in clusters) == list(range(len(clusters)))
    assert sum(c["size"] for c in clusters) == passed and {c["cluster_label"] for c in clusters} == {"A Usable Label"}
    assert stored["cluster_sweep"].where("is_best_k").count() == 1
    assert stored["cluster_kb_sim"].count() == len(clusters) * given["knowledge_base_articles"].count()

    keep(steps.gap_analysis(tables(), "run1", "2024-01-02", LIMITS, chat_fn=chat))
    gaps = stored["gap_analysis"].collect()
    assert len(gaps) == len(clusters) and sum(g["size"] for g in gaps) == passed
    merged = [g for g in gaps if g["gap_flag"] == "DUPLICATE"]
    assert all(g["size"] == 0 and g["merged_into"] is not None for g in merged)
    assert stored["cluster_assignments"].join(stored["gap_analysis"].where("gap_flag = 'DUPLICATE'"), ["run_id", "cluster_id"]).isEmpty()
    assert stored["kb_utilization"].count() == given["knowledge_base_articles"].count()

    keep(steps.review(tables(), "run1", chat))
    assert stored["clusters"].count() == len(clusters)

    keep(steps.drafting(tables(), "run1", chat, hashed_bag_of_words(), LIMITS))
    open_gaps = stored["gap_analysis"].where("gap_flag IN ('CRITICAL', 'PARTIAL')").count()
    articles = stored["generated_kb_articles"]
    assert articles.count() == open_gaps > 0 and articles.where("article_embedding IS NULL").isEmpty()
    assert stored["kb_search_index"].where("is_generated").count() == open_gaps

    live = articles.where("is_duplicate_of IS NULL").count()
    keep(steps.validation(tables(), "run1", chat, LIMITS))
    assert stored["kb_validation_results"].count() == live and stored["evaluation_results"].count() == 6
    assert stored["generated_kb_articles"].count() == open_gaps

    # Again from step 4: generated entries survive it, results about replaced articles go with them.
    keep(steps.gap_analysis(tables(), "run1", "2024-01-02", LIMITS, chat_fn=chat))
    assert stored["kb_search_index"].where("is_generated").count() == open_gaps
    other = stored["evaluation_results"].limit(1).withColumn("category", F.lit("other"))
    steps.store({"evaluation_results": stored["evaluation_results"].unionByName(other)}, folder, "run1")
    keep(steps.drafting(tables(), "run1", chat, hashed_bag_of_words(), LIMITS))
    assert "kb_validation_results" not in stored
    stored["evaluation_results"] = spark.read.parquet(f"{folder}/evaluation_results")
    keep(steps.validation(tables(), "run1", chat, LIMITS))
    assert stored["evaluation_results"].where("category = 'other'").count() == 1 and stored["evaluation_results"].count() == 7

    # Too few tickets: only the coverage is left of the clustering step's tables.
    few = {**tables(), "ticket_embeddings": te.limit(3)}
    steps.store(steps.clustering(few, "run1", LIMITS, stop_words=[]), folder, "run1", "clustering")
    assert glob(f"{folder}/ticket_coverage/run_id=run1") and not glob(f"{folder}/cl*/run_id=run1")
    drop_run(spark, folder, RUN_TABLES, "run1")
    assert not glob(f"{folder}/*/run_id=run1")
