"""Principal axes against the definition and numpy's eigenvectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapscope.operators.axes import principal_axes, project, strongest


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)], "id long, v array<double>")


def test_axes_solve_the_eigen_equation(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    found = principal_axes(e, "embedding", 3)
    x = np.array([r["embedding"] for r in e.where("embedding IS NOT NULL").collect()], dtype=float)
    c = np.cov(x.T, bias=True)
    for axis, variance in zip(found.axes, found.variances):
        assert np.abs(c @ axis - variance * axis).max() < 1e-8
        assert axis[np.abs(axis).argmax()] > 0
    assert np.abs(found.axes @ found.axes.T - np.eye(3)).max() < 1e-8
    assert found.variances == pytest.approx(np.linalg.eigvalsh(c)[::-1][:3], abs=1e-10) and found.whole == pytest.approx(np.trace(c))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_split_of_the_rows_does_not_matter(spark, parts):
    rng = np.random.default_rng(5)
    rows = list(1000 + rng.normal(size=(200, 6)) * [5, 4, 3, 2, 1, 0.5])  # far from the origin
    want = principal_axes(table(spark, rows).coalesce(1), "v", 6)
    got = principal_axes(table(spark, rows[::-1]).repartition(parts), "v", 6)
    assert got.axes == pytest.approx(want.axes, abs=1e-9) and got.variances == pytest.approx(want.variances, rel=1e-9)
    values = np.linalg.eigvalsh(np.cov(np.array(rows).T, bias=True))[::-1]
    assert want.variances == pytest.approx(values, rel=1e-9)


def test_no_vectors_one_vector_and_a_line(spark):
    none = table(spark, [None, None])
    assert [r["x"] for r in project(none, "v", principal_axes(none, "v"), ["x", "y"]).collect()] == [None, None]
    assert project(table(spark, []), "v", principal_axes(table(spark, []), "v"), ["x", "y"]).columns == ["id", "v", "x", "y"]
    one = table(spark, [[3, 4], [3, 4], None])
    assert [(r["x"], r["y"]) for r in project(one, "v", principal_axes(one, "v"), ["x", "y"]).orderBy("id").collect()] == [(0, 0), (0, 0), (None, None)]
    line = table(spark, [[-1, 0], [0, -1], [-2, 1]])  # one direction only; equal components, so the first is positive
    found = principal_axes(line, "v")
    assert found.axes[0] == pytest.approx([0.5**0.5, -(0.5**0.5)]) and found.variances[1] == 0 and not found.axes[1].any()
    got = project(line, "v", found, ["x", "y"]).orderBy("id").collect()
    assert [r["x"] for r in got] == pytest.approx([0, 2**0.5, -(2**0.5)], abs=1e-12) and [r["y"] for r in got] == [0, 0, 0]


def test_near_equal_variances(spark):
    c = np.diag([1.0, 1.0 - 1e-9, 0.5])
    assert strongest(c) == pytest.approx([1, 0, 0], abs=1e-8)
    both = strongest(np.diag([1.0, 1.0, 0.5]))  # any direction of the two is right
    assert np.diag([1.0, 1.0, 0.5]) @ both == pytest.approx(both, abs=1e-12)


def test_coordinates_stay_in_the_jvm(spark):
    df = table(spark, [[1, 2], [3, 5], [0, 1]])
    plan = project(df, "v", principal_axes(df, "v"), ["x", "y"]).agg(F.sum("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
