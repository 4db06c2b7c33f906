"""Reports read from the rollup equal those read from the assignments."""

import pytest
from pyspark.sql import functions as F

from gapscope.operators.rounds import cut
from gapscope.plans import reports as rp
from gapscope.plans import rollup as ru
from gapscope.queries.roles import Tables


@pytest.fixture(scope="module")
def run(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    return cut(t.assignments()), cut(t.gaps()), cut(t.clusters()), cut(ru.rollup(t.assignments(), t.gaps()))


def rows(df):
    return sorted(map(str, (sorted(r.asDict().items()) for r in df.collect())))


def test_reports_are_the_same(run):
    a, g, c, table = run
    pairs = [
        (rp.source_counts(a), ru.source_counts(table)), (rp.source_mix(a), ru.source_mix(table)),
        (rp.source_mix_per_cluster(a, c), ru.source_mix_per_cluster(table, c)), (rp.workorder_clusters(a), ru.workorder_clusters(table)),
        (rp.incident_dominant(a, c), ru.incident_dominant(table, c)), (rp.service_breakdown(a, g), ru.service_breakdown(table)),
        (rp.service_breakdown(a, g, "incident"), ru.service_breakdown(table, "incident")), (rp.service_pivot(rp.service_breakdown(a, g)), ru.service_pivot(table)),
        (rp.source_pivot(rp.source_mix_per_cluster(a, c)), ru.source_pivot(table, c)),
    ]
    for old, new in pairs:
        assert rows(old) == rows(new) and rows(new)
    assert rows(rp.flag_totals(g)) == rows(ru.flag_totals(table))
    assert rows(rp.gap_distribution(g).select("run_id", "gap_flag", "clusters")) == rows(ru.gap_distribution(table).select("run_id", "gap_flag", "clusters"))


def test_assignments_are_read_once(spark, run):
    a, g, _, _ = run
    plan = ru.rollup(a, g)._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 2  # assignments and flags


def test_clusters_without_tickets_and_without_flags(spark):
    a = spark.createDataFrame([("r", 1, "incident", "x"), ("r", 1, "incident", None), ("r", 9, None, "x")], "run_id string, cluster_id long, source string, service_type string")
    g = spark.createDataFrame([("r", 1, "CRITICAL"), ("r", 2, "PARTIAL")], "run_id string, cluster_id long, gap_flag string")
    got = {tuple(r) for r in ru.rollup(a, g).select("level", "cluster_id", "source", "service_type", "gap_flag", "tickets").collect()}
    assert got == {
        ("cluster", 1, None, None, "CRITICAL", 2), ("cluster", 2, None, None, "PARTIAL", 0), ("cluster", 9, None, None, None, 1),
        ("cluster_source", 1, "incident", None, None, 2), ("cluster_source", 9, None, None, None, 1), ("source", None, "incident", None, None, 2), ("source", None, None, None, None, 1),
        ("service_flag", None, None, "x", "CRITICAL", 1), ("service_flag", None, None, None, "CRITICAL", 1), ("service_flag", None, None, "x", None, 1),
        ("source_service_flag", None, "incident", "x", "CRITICAL", 1), ("source_service_flag", None, "incident", None, "CRITICAL", 1), ("source_service_flag", None, None, "x", None, 1),
        ("flag", None, None, None, "CRITICAL", 2), ("flag", None, None, None, "PARTIAL", 0), ("flag", None, None, None, None, 1), ("run", None, None, None, None, 3),
    }
    assert ru.rollup(a.limit(0), g.limit(0)).count() == 0
