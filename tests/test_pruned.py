"""Pruned pairs equal all pairs above a bound; cells that lie apart are skipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapscope.operators import pruned
from gapscope.operators.rounds import cut
from gapscope.operators.similarity import pairs_above


def clustered(spark, n=1500):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(30, 24)) * 4
    rows = []
    for k in range(n):
        c = 0 if k % 3 == 0 else k % 30  # a third of the rows in one cluster
        v = centre[c] + rng.normal(size=24) * 0.4
        rows.append((k, "x" if k % 5 else None, [float(x) for x in (v * (1 + k % 3))]))
    rows += [(5000 + k, "x", rows[7][2]) for k in range(20)] + [(6000, "x", None), (6001, "x", [0.0] * 24), (6002, "alone", rows[3][2])]
    return cut(spark.createDataFrame(rows, "id long, g string, v array<double>").repartition(4))


def triples(df, *by):
    return sorted(map(str, ((*(r[c] for c in by), r.a, r.b, r.sim) for r in df.collect())))


@pytest.mark.parametrize("bound", [0.999, 0.95, 0.5, 0.0])
@pytest.mark.parametrize("layout", [{}, {"broadcast_bytes": 0, "block_rows": 64}])
def test_equals_all_pairs(spark, bound, layout):
    df = clustered(spark, 600)
    got = triples(pruned.pruned_pairs_above(df, "id", "v", bound, cell_rows=24, **layout))
    assert got == triples(pairs_above(df, "id", "v", bound)) and got


def test_groups_and_text_keys(spark):
    df = clustered(spark, 400).select(F.concat(F.lit("k"), "id").alias("id"), F.coalesce("g", F.lit("none")).alias("g"), "v")
    got = triples(pruned.pruned_pairs_above(df, "id", "v", 0.9, by=["g"], cell_rows=16), "g")
    assert got == triples(pairs_above(df, "id", "v", 0.9, by=["g"]), "g") and got


def test_most_pairs_of_cells_are_skipped(spark):
    rows, bounds = pruned.in_cells(clustered(spark), "id", "v", cell_rows=24)
    cells, near = bounds.count(), pruned.near_cells(bounds, 0.9).count()
    all_pairs = cells * (cells + 1) // 2
    print(f"{all_pairs - near} of {all_pairs} pairs of cells skipped")
    assert rows.groupBy("cell").count().agg(F.max("count")).first()[0] < 400  # the large cluster is many cells
    assert near < 0.5 * all_pairs


def test_below_zero_and_empty(spark):
    df = clustered(spark, 60)
    assert triples(pruned.pruned_pairs_above(df, "id", "v", -0.2)) == triples(pairs_above(df, "id", "v", -0.2))
    assert pruned.pruned_pairs_above(df.limit(0), "id", "v", 0.5).count() == 0
    assert pruned.pruned_pairs_above(df.limit(0), "id", "v", 0.5, by=["g"]).count() == 0


def shuffled_rows(spark):
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_row_is_sent_once_per_tile_not_per_cell(spark, monkeypatch):
    monkeypatch.setattr(pruned, "SPREAD", 2, raising=False)
    rng = np.random.default_rng(9)
    df = cut(spark.createDataFrame([(k, [float(x) for x in rng.normal(size=32)]) for k in range(2000)], "id long, v array<double>").repartition(4))
    before = shuffled_rows(spark)
    found = pruned.pruned_pairs_above(df, "id", "v", 0.4, cell_rows=32)
    placing, before = shuffled_rows(spark) - before, shuffled_rows(spark)
    assert found.count() > 0
    assert shuffled_rows(spark) - before < 2000 * 16 and placing > 0  # nearly all of 60 cells are near
