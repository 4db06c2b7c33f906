"""Mini-batch k-means against a one-model-at-a-time version that is fed the same batches, and against full fits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapscope.operators import clustering as cl
from gapscope.operators import minibatch as mb
from gapscope.operators.rounds import cut
from gapscope.plans import coverage as cv
from gapscope.queries.roles import Tables


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 5)) * 3
    rows = [(k, [float(x) for x in rng.normal(size=5) + centre[min(k % 9, 5)]]) for k in range(700)]
    # One cluster holds a third of the rows; a far row starves its centre; rows without a vector stay out.
    rows += [(1000 + k, [50.0, 50.0, 50.0, 50.0, float(k)]) for k in range(3)] + [(2000, None), (2001, None)]
    return cut(spark.createDataFrame(rows, "id long, v array<double>").repartition(3))


def one_at_a_time(dealt, spark, start, epochs):
    """A single model, row by row: rows of its batches in any order, fresh centres in the order of a hash."""
    model, rows = start, [(r["__key"], r["__batch"], np.array(r.vec)) for r in dealt.rows.collect()]
    hashes = {}

    def order(turn):
        if turn not in hashes:
            hashes[turn] = {r["__key"]: r.h for r in dealt.rows.select("__key", F.xxhash64("__key", F.lit(turn)).alias("h")).collect()}
        return hashes[turn]

    centres, seen = [np.array(c) for c in model], [0] * len(model)
    smooth, best, idle, unfed, rounds, replaced = None, math.inf, 0, 0, 0, 0
    for turn in range(epochs * dealt.batches):
        batch = [(k, v) for k, b, v in rows if b == turn % dealt.batches]
        pick = [min(range(len(centres)), key=lambda c: ((v - centres[c]) ** 2).sum()) for _, v in batch]
        cost = sum(((v - centres[c]) ** 2).sum() for (_, v), c in zip(batch, pick))
        for c in range(len(centres)):
            own = [v for (_, v), p in zip(batch, pick) if p == c]
            seen[c] += len(own)
            if own:
                step = len(own) / seen[c]
                centres[c] = (1 - step) * centres[c] + step * np.mean(own, axis=0)
        unfed += len(batch)
        if 0 in seen or unfed >= 10 * len(centres):
            unfed = 0
            poor = sorted((c for c in range(len(centres)) if seen[c] < 0.01 * max(seen)), key=lambda c: seen[c])[: len(batch) // 2]
            fresh = sorted(batch, key=lambda r: order(turn)[r[0]])
            rest = min((seen[c] for c in range(len(centres)) if c not in poor), default=0)
            for c, (_, v) in zip(poor, fresh):
                centres[c], seen[c] = v.copy(), rest
                replaced += 1
        rounds += 1
        weight = min(1.0, 2 * len(batch) / (dealt.total + 1))
        smooth = cost / len(batch) if smooth is None else smooth * (1 - weight) + cost / len(batch) * weight
        idle = 0 if smooth < best * (1 - mb.LEAST_FALL) else idle + 1
        best = smooth if idle == 0 else best
        if idle == mb.PATIENCE:
            break
    return np.array(centres), rounds, replaced


@pytest.mark.parametrize("batch_rows", [100, 5000])
def test_side_by_side_equals_one_at_a_time(spark, points, batch_rows):
    dealt = mb.deal(points, "id", "v", batch_rows)
    assert dealt.total == 703 and dealt.batches == (8 if batch_rows == 100 else 1)
    asked = [(3, 0), (3, 1), (9, 0)]
    models = mb.fit_models(dealt, asked, epochs=40, sample_rows=300)
    sample = dealt.first_rows(dealt.rows, 300, mb.SEED + 1)
    some = 0
    for (k, start), model in zip(asked, models):
        want, rounds, replaced = one_at_a_time(dealt, spark, mb.far_apart(sample, k, np.random.default_rng([mb.SEED, k, start])), 40)
        assert model.rounds == rounds and np.abs(model.centres - want).max() < 1e-9
        some += replaced
    assert some > 0  # starved centres were met


def test_costs_sizes_and_silhouettes(spark, points):
    dealt = mb.deal(points, "id", "v", 100)
    x = np.array([r.vec for r in dealt.rows.collect()])
    models = [mb.Model(2, 0, x[:2].copy()), mb.Model(3, 0, np.vstack([x[2:4], [[1e6] * 5]])), mb.Model(1, 0, x[:1].copy())]
    fits = {f.k: f for f in mb.best_fits(dealt, models, True)}
    for m in models:
        apart = ((x[:, None] - m.centres) ** 2).sum(axis=2)
        own = apart.argmin(axis=1)
        sizes = np.bincount(own, minlength=m.k)
        assert fits[m.k].inertia == pytest.approx(apart.min(axis=1).sum()) and fits[m.k].sizes.tolist() == sizes.tolist()
        if m.k == 1:
            assert fits[1].silhouette == -1.0
            continue
        pair = ((x[:, None] - x) ** 2).sum(axis=2)
        mean = np.array([pair[:, own == c].mean(axis=1) if sizes[c] else np.full(len(x), np.inf) for c in range(m.k)]).T
        a = np.array([pair[i, own == own[i]].sum() / max(1, sizes[own[i]] - 1) for i in range(len(x))])
        mean[np.arange(len(x)), own] = np.inf
        b = mean.min(axis=1)
        s = np.where(sizes[own] > 1, (b - a) / np.maximum(a, b), 0)
        assert fits[m.k].silhouette == pytest.approx(s.mean())


def test_best_start_wins_and_ids_are_ordered(spark, points):
    out = mb.kmeans(points, "id", "v", 4, tries=3, batch_rows=200)
    rows = out.collect()
    assert out.columns == ["id", "v", "cluster_id"] and {r.cluster_id for r in rows if r.v is None} == {None}
    means = [np.mean([r.v for r in rows if r.cluster_id == c], axis=0)[0] for c in range(4)]
    assert len({r.cluster_id for r in rows}) == 5 and len(rows) == 705
    assert {r["id"]: r.cluster_id for r in mb.kmeans(points, "id", "v", 4, tries=3, batch_rows=200).collect()} == {r["id"]: r.cluster_id for r in rows}
    assert len(means) == 4


def test_void_and_small_inputs(spark):
    few = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None)], "id long, v array<double>")
    swept = {r.k: r for r in mb.sweep(few, "id", "v", (1, 2, 7), tries=2).collect()}
    assert swept[7].inertia == swept[2].inertia == float("inf") and swept[1].inertia == 0.0 and swept[1].silhouette == -1.0 and swept[1].max_share == 1.0
    assert {r["id"]: r.cluster_id for r in mb.kmeans(few, "id", "v", 9, tries=1).collect()}[3] is None
    assert mb.sweep(few.limit(0), "id", "v", (3,)).first().max_share == 1.0 and mb.kmeans(few.limit(0), "id", "v", 2).count() == 0
    same = spark.createDataFrame([(k, [1.0, 1.0]) for k in range(30)], "id long, v array<double>")
    assert mb.sweep(same, "id", "v", (3,), tries=1).first().inertia == 0.0
    with pytest.raises(ValueError):
        mb.fit_models(mb.deal(same, "id", "v"), [(10**8, 0)])


@pytest.mark.parametrize("batch_rows", [mb.BATCH_ROWS, 512])
def test_cost_is_near_that_of_full_fits(spark, batch_rows):
    df = cut(cv.working_vectors(Tables(spark, "/root/testdata/sf0.1").ticket_vectors()).select("ticket_id", "cluster_vec"))
    got = {r.k: r.inertia for r in mb.sweep(df, "ticket_id", "cluster_vec", (10, 30), batch_rows=batch_rows).collect()}
    full = {r.k: r.inertia for r in cl.sweep(df, "cluster_vec", (10, 30)).collect()}
    assert all(got[k] <= 1.02 * full[k] for k in full)
