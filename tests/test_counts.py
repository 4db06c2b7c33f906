"""Counters observed while tables are written, against the count queries over the same rows."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gapscope.operators.rounds import cut
from gapscope.plans import counts, steps
from gapscope.plans import coverage as cv
from gapscope.plans import preprocess as pp
from gapscope.plans import review as rv
from gapscope.queries import coverage as qc
from gapscope.queries.roles import Tables
from gapscope.sources import sinks as sk
from gapscope.sources import tables as tb

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import this file


@pytest.fixture(scope="module")
def given(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def executions(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_funnel_and_statistics_come_with_the_write(spark, given, tmp_path):
    inc, wo = cut(pp.judge_incidents(pp.incident_features(given.incident_inputs()))), cut(pp.judge_workorders(qc.workorder_features(given)))
    table = pp.embeddings_table(inc, "incident", "r1").unionByName(pp.embeddings_table(wo, "workorder", "r1"))
    got = steps.store({"ticket_embeddings": table}, str(tmp_path), "r1")["ticket_embeddings"]
    for df, many in ((inc, "incidents"), (wo, "workorders")):
        assert {k.removesuffix("_" + many): v for k, v in got.items() if k.endswith("_" + many)} == pp.drop_funnel(df).first().asDict()
    want = pp.step_statistics(inc, wo, given.kb()).first()
    assert (got["total_incidents"], got["usable_incidents"], got["total_workorders"], got["usable_workorders"]) == (
        want.total_incidents, want.usable_incidents, want.total_workorders, want.usable_workorders)
    assert got["usable_incidents"] + got["usable_workorders"] == want.total_embedded > 0


def test_counting_runs_nothing_of_its_own(spark, given, tmp_path):
    table = cut(qc.ticket_coverage_table(given).withColumn("run_id", F.lit("r1")))
    before = executions(spark)
    sk.stage(table, str(tmp_path / "plain"))
    plain = executions(spark) - before
    got = steps.store({"ticket_coverage": table}, str(tmp_path), "r1")["ticket_coverage"]
    assert executions(spark) - before - plain == plain == 1
    want = {r["coverage"].lower(): r["tickets"] for r in cv.coverage_counts(table).collect()}
    assert {k: v for k, v in got.items() if v and k != "total"} == want and got["total"] == sum(want.values())


def test_drafts_flags_and_empty_tables(spark, given, tmp_path):
    drafts = given.articles().withColumn("run_id", F.lit("r1"))
    gaps = given.gaps().withColumn("run_id", F.lit("r1"))
    got = steps.store({"generated_kb_articles": drafts, "gap_analysis": gaps, "other": gaps}, str(tmp_path), "r1")
    index = given.search_index().withColumn("run_id", F.lit("r1"))
    want = sk.reindex_counts(index, drafts).first()
    assert got["generated_kb_articles"] == {"total": want.total, "inserted": want.inserted}
    flags = {r["gap_flag"].lower(): r["count"] for r in gaps.groupBy("gap_flag").count().collect()}
    assert {k: v for k, v in got["gap_analysis"].items() if v and k != "total"} == flags and "other" not in got
    none = steps.store({"gap_analysis": gaps.where("false"), "generated_kb_articles": spark.createDataFrame([], drafts.schema)}, str(tmp_path), "r1")
    assert set(none["gap_analysis"].values()) == {0} and none["generated_kb_articles"] == {"total": 0, "inserted": 0}


def test_counts_do_not_depend_on_partitions_or_null_rows(spark, tmp_path):
    rows = [(None, None, "a"), ("COVERED", 1, "b"), ("UNCOVERED", 2, "c")] * 50
    df = spark.createDataFrame(rows, "coverage string, n int, x string").withColumn("run_id", F.lit("r1"))
    for parts in (1, 7, 200):
        got = steps.store({"ticket_coverage": df.repartition(parts)}, str(tmp_path / str(parts)), "r1")["ticket_coverage"]
        assert got == {"total": 150, "covered": 50, "partial": 0, "uncovered": 50}


def test_opinions_are_counted_while_they_are_stored(spark, given):
    def chat(prompt):
        return "not json" if len(prompt) % 3 == 0 else '{"match_found": %s, "matched_kb_id": "1", "matched_kb_title": "Known", "confidence": "high", "reasoning": "x"}' % ("true" if len(prompt) % 3 == 1 else "false")

    run = given.clusters().where("gap_flag = 'CRITICAL' AND summary <> ''").first()["run_id"]
    kb = given.kb().select(
        F.col("kb_id").cast("string").alias("id"), "title", "issue", "solution", F.to_json("kb_vec").alias("e_title"), F.lit(None).cast("string").alias("e_solution")
    )
    clusters = given.clusters().withColumn("centroid", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * (F.col("cluster_id") + 1)))).withColumn("top_terms", F.lit("a"))
    tables = {"clusters": clusters, "knowledge_base_articles": kb, "gap_analysis": given.gaps()}
    counted = {}
    out = steps.review(tables, run, chat, counted)
    critical = tb.critical_with_summary(tb.of_run(tables["clusters"], run))
    again = rv.opinions(rv.candidate_prompts(critical, rv.candidates(critical, steps.articles_of(tables))), chat)
    assert counted["opinions"] == rv.review_counts(critical, again).first().asDict()
    assert counted["opinions"]["asked"] == critical.count() and counted["opinions"]["failed"] + counted["opinions"]["validated"] == critical.count()
    assert out["clusters"].where("review_confidence IS NOT NULL").count() == counted["opinions"]["validated"]


def test_watched_rows_are_unchanged(spark):
    df = spark.range(10)
    same, seen = counts.watched(df, {"n": F.count("*"), "high": F.count_if(F.col("id") > 6)})
    assert sorted(r.id for r in same.collect()) == list(range(10)) and seen.get == {"n": 10, "high": 3}
