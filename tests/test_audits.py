"""The chi-square tail against closed forms."""

import math

import pytest
from pyspark.sql import functions as F

from gapscope.plans.audits import bias_statistic, chi_square_tail


def tail(x, d):
    if d % 2 == 0:
        return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(d // 2))
    rest = sum((x / 2) ** (i - 0.5) / math.gamma(i + 0.5) for i in range(1, d // 2 + 1))
    return math.erfc(math.sqrt(x / 2)) + math.exp(-x / 2) * rest


def test_chi_square_tail(spark):
    cases = [(x, d) for d in (1, 2, 3, 4, 7, 12, 15, 40) for x in (0.01, 0.5, 1.0, 3.84, 10.0, 25.0, 60.0, 130.0)]
    df = spark.createDataFrame([*cases, (0.0, 3), (5.0, 0), (1e7, 4)], "x double, d long")
    got = {(r.x, r.d): r.p for r in df.withColumn("p", chi_square_tail(F.col("x"), F.col("d"))).collect()}
    for x, d in cases:
        assert got[x, d] == pytest.approx(tail(x, d), abs=1e-9)
    assert got[0.0, 3] == 1.0 and got[5.0, 0] == 1.0 and got[1e7, 4] == 0.0


def test_a_run_without_critical_cells_has_no_most_affected_service(spark):
    rows = [(run, k % 4, "ab"[k % 3 % 2]) for run in ("r1", "r2") for k in range(24)]
    assignments = spark.createDataFrame(rows, "run_id string, cluster_id long, service_type string")
    gaps = spark.createDataFrame([(run, c, "COVERED" if c % 2 else flag) for run, flag in (("r1", "PARTIAL"), ("r2", "CRITICAL")) for c in range(4)], "run_id string, cluster_id long, gap_flag string")
    got = {r.run_id: r.most_affected for r in bias_statistic(assignments, gaps).collect()}
    assert got["r1"] is None and got["r2"] in "ab"
