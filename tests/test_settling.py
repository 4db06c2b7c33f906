"""Full k-means fits: rounds from bounds against rounds that compare all rows, sent rows against rows read in every round."""

import numpy as np
import pytest

from gapscope.operators import clustering as cl
from gapscope.operators.settling import settle


def plain(rows, centres, max_iter, least_move):
    for _ in range(max_iter):
        pick = ((rows[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        before, centres = centres, np.array([rows[pick == c].mean(axis=0) if (pick == c).any() else centres[c] for c in range(len(centres))])
        if np.sqrt(((centres - before) ** 2).sum(axis=1)).max() <= least_move:
            break
    return centres


@pytest.mark.parametrize("k", [1, 2, 9])
@pytest.mark.parametrize("rounds", [1, 4, 60])
@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e6])
def test_bounds_change_no_place(k, rounds, scale):
    rng = np.random.default_rng(k)
    rows = np.vstack([rng.normal(size=(5000, 4)), np.repeat(rng.normal(size=(1, 4)), 40, axis=0)]) * scale
    start = rows[:k].copy()
    if k == 9:
        start[8] = 1e3 * scale  # no row is nearest to it
    got = settle(rows, start.copy(), rounds, 1e-4 * scale)
    assert np.abs(got - plain(rows, start, rounds, 1e-4 * scale)).max() < 1e-9 * scale


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 3)))]
    return spark.createDataFrame([*rows, *rows[:30], (400, None)], "id long, v array<double>").repartition(3).cache()


def test_sent_rows_give_what_read_rows_give(points, monkeypatch):
    swept = lambda: [tuple(r) for r in cl.sweep(points, "v", (2, 7, 30, 1000), tries=2, max_iter=12).collect()]
    placed = lambda: {(r["id"], r["cluster_id"]) for r in cl.kmeans(points, "v", 4, tries=2, max_iter=12).collect()}
    sent, sent_ids = swept(), placed()
    monkeypatch.setattr(cl, "HELD_BYTES", 0)
    read, read_ids = swept(), placed()
    assert [r[0] for r in sent] == [2, 7, 30, 1000] and sent[-1] == read[-1] and sent_ids == read_ids
    assert np.array(sent[:-1]) == pytest.approx(np.array(read[:-1]))


def test_jobs_of_a_sweep_do_not_grow_with_its_rounds(spark, points):
    context = spark.sparkContext

    def jobs(rounds):
        context.setJobGroup(f"rounds-{rounds}", "")
        cl.sweep(points, "v", (2, 7, 30), tries=2, max_iter=rounds).collect()
        context.setLocalProperty("spark.jobGroup.id", None)
        return len(context.statusTracker().getJobIdsForGroup(f"rounds-{rounds}"))

    assert 0 < jobs(12) <= jobs(1) + 1
