"""Greedy rules against the plain sequential form of the rule."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapscope.operators import merging as mg
from gapscope.operators.rounds import cut, numbered


def sequential_merges(pairs, size):
    gone = {}
    for sim, a, b in sorted(((-s, a, b) for (a, b), s in pairs.items())):
        if a in gone or b in gone:
            continue
        keep, drop = (a, b) if size[a] >= size[b] else (b, a)
        gone[drop] = keep
    return gone


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_merges_equals_sequential(spark, seed):
    rnd = random.Random(seed)
    rows, sizes, want = [], [], {}
    for run in ("r1", "r2"):
        n = 14
        size = {i: rnd.randint(1, 6) for i in range(n)}
        pairs = {(i, j): round(rnd.random(), 2) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.4}
        rows += [(run, a, b, s, "why") for (a, b), s in pairs.items()]
        sizes += [(run, i, s) for i, s in size.items()]
        want.update({(run, d): k for d, k in sequential_merges(pairs, size).items()})
    accepted = spark.createDataFrame(rows, "run_id string, a long, b long, sim double, reason string")
    got = mg.greedy_merges(accepted, spark.createDataFrame(sizes, "run_id string, cluster_id long, size long"))
    assert {(r["run_id"], r["cluster_id"]): r["merged_into"] for r in got.collect()} == want


def test_star_of_copies_and_chain(spark):
    star = [("r", 0, i, 0.99, "") for i in range(1, 40)]
    chain = [("c", i, i + 1, 0.5 + i / 100, "") for i in range(10)]
    sizes = [("r", i, 100 - i) for i in range(40)] + [("c", i, 100 - i) for i in range(11)]
    accepted = spark.createDataFrame(star + chain, "run_id string, a long, b long, sim double, reason string")
    got = mg.greedy_merges(accepted, spark.createDataFrame(sizes, "run_id string, cluster_id long, size long")).collect()
    assert {r["cluster_id"]: r["merged_into"] for r in got if r["run_id"] == "r"} == {i: 0 for i in range(1, 40)}
    want = sequential_merges({(i, i + 1): 0.5 + i / 100 for i in range(10)}, {i: 100 - i for i in range(11)})
    assert {r["cluster_id"]: r["merged_into"] for r in got if r["run_id"] == "c"} == want


@pytest.mark.parametrize("seed, layout", [(1, {}), (2, {"broadcast_bytes": 0, "block_rows": 7}), (3, {"batch": 1})])
def test_merge_by_asking_equals_asking_about_all(spark, seed, layout):
    rng = np.random.default_rng(seed)
    rows, want, every = [], {}, 0
    for run in "pqrstuvw":
        n = 24
        v = rng.normal(size=(n, 3))
        if run in "pq":
            v[4:16] = v[3]  # a crowd of copies
        size = {i: int(x) for i, x in enumerate(rng.integers(1, 5, n))}
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        sim = np.round(unit @ unit.T, 9)
        pairs = {(i, j): sim[i, j] for i in range(n) for j in range(i + 1, n) if sim[i, j] > 0.3}
        every += len(pairs)
        held = {p: s for p, s in pairs.items() if (p[0] * 7 + p[1] * 3) % 4}
        want.update({(run, d): k for d, k in sequential_merges(held, size).items()})
        rows += [(run, i, size[i], [float(x) for x in v[i]]) for i in range(n)]
    asked = []

    def decide(found):
        asked.extend(tuple(r) for r in found.select("run_id", "a", "b").collect())
        return found.where((F.col("a") * 7 + F.col("b") * 3) % 4 != 0).withColumn("reason", F.lit("x"))

    df = spark.createDataFrame(rows, "run_id string, cluster_id long, size long, centroid array<double>")
    got = mg.merge_by_asking(df, decide, 0.3, **layout)
    assert {(r["run_id"], r["cluster_id"]): r["merged_into"] for r in got.collect()} == want
    assert len(asked) == len(set(asked)) and len(asked) < every


def test_merge_by_asking_without_pairs(spark):
    df = spark.createDataFrame([("r", 1, 1, [1.0, 0.0]), ("r", 2, 1, [0.0, 1.0])], "run_id string, cluster_id long, size long, centroid array<double>")
    assert mg.merge_by_asking(df, lambda found: found, 0.5).isEmpty()


def test_resolve_chains(spark):
    m = spark.createDataFrame([("r", i, i + 1) for i in range(9)] + [("q", 1, 5)], "run_id string, cluster_id long, merged_into long")
    got = {(r["run_id"], r["cluster_id"]): r["merged_into"] for r in mg.resolve_chains(m).collect()}
    assert got == {**{("r", i): 9 for i in range(9)}, ("q", 1): 5}


def sequential_priority(sizes, scores, merges):
    """One merge after another; merges as (duplicate, remaining) by duplicate id."""
    scale = lambda v: (lambda lo, hi: [(x - lo) / (hi - lo) if hi > lo else 0.0 for x in v])(min(v), max(v))
    sizes, scores = dict(sizes), dict(scores)
    ids = sorted(sizes)
    for dup, keep in merges:
        at = ids.index(keep)
        old = scale([sizes[i] for i in ids])[at]
        new_size = sizes[keep] + sizes[dup]
        new = scale([new_size if i == keep else sizes[i] for i in ids])[at]
        scores[keep] = round(scores[keep] - 0.35 * old + 0.35 * new, 4)
        sizes[keep], sizes[dup] = new_size, 0
    return sizes, scores


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_repair_priority_equals_sequential(spark, seed):
    rnd = random.Random(seed)
    n = 12
    sizes = {i: rnd.randint(5, 60) for i in range(n)}
    scores = {i: round(rnd.random(), 4) for i in range(n)}
    dups = sorted(rnd.sample(range(n), 6))
    keep = [i for i in range(n) if i not in dups]
    merges = [(d, rnd.choice(keep)) for d in dups]
    gaps = spark.createDataFrame(
        [("r", i, sizes[i], scores[i], "CRITICAL", "text") for i in range(n)],
        "run_id string, cluster_id long, size long, priority_score double, gap_flag string, recommendation string",
    )
    m = spark.createDataFrame([("r", d, k) for d, k in merges], "run_id string, cluster_id long, merged_into long")
    want_sizes, want_scores = sequential_priority(sizes, scores, merges)
    for r in mg.repair_priority(gaps, m).collect():
        assert r["size"] == want_sizes[r["cluster_id"]]
        assert r["priority_score"] == pytest.approx(want_scores[r["cluster_id"]], abs=2e-4)
        assert (r["gap_flag"] == "DUPLICATE") == (r["cluster_id"] in dups)


def sequential_duplicates(vectors, quality, bound):
    m = np.array(vectors)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = np.round(m @ m.T, 9)
    of = {}
    for i in range(len(m)):
        if i in of:
            continue
        for j in range(i + 1, len(m)):
            if j in of or sim[i, j] <= bound:
                continue
            keep, dup = (i, j) if quality[i] >= quality[j] else (j, i)
            of[dup] = keep
    return of


@pytest.mark.parametrize("seed, layout", [(1, {}), (2, {"block_rows": 6}), (3, {"broadcast_bytes": 0, "block_rows": 6}), (4, {})])
def test_duplicate_articles_equals_sequential(spark, seed, layout):
    rng = np.random.default_rng(seed)
    rows, want = [], {}
    for run in ("a", "b"):
        n = 30
        v = rng.normal(size=(n, 3))
        v[10:16] = v[9]  # copies
        q = rng.integers(3, 7, n)
        rows += [(run, 100 + i, i, int(q[i]), [float(x) for x in v[i]]) for i in range(n)]
        want.update({(run, 100 + d): 100 + k for d, k in sequential_duplicates(v, q, 0.8).items()})
    df = spark.createDataFrame(rows, "run_id string, cluster_id long, position long, quality_score int, article_embedding array<double>")
    got = mg.duplicate_articles(df, bound=0.8, **layout)
    assert {(r["run_id"], r["cluster_id"]): r["duplicate_of"] for r in got.collect()} == want


def test_move_and_merge(spark):
    a = spark.createDataFrame([("r", "t1", 1, "one"), ("r", "t2", 2, "two"), ("r", "t3", 2, "two"), ("s", "t4", 2, "other")], "run_id string, source_id string, cluster_id long, cluster_label string")
    c = spark.createDataFrame([("r", 1, "one", 1, "CRITICAL"), ("r", 2, "two", 2, "CRITICAL"), ("s", 2, "other", 1, "COVERED")], "run_id string, cluster_id long, cluster_label string, size long, gap_flag string")
    m = spark.createDataFrame([("r", 2, 1)], "run_id string, cluster_id long, merged_into long")
    moved = mg.move_tickets(a, m, c)
    assert {(r["source_id"], r["cluster_id"], r["cluster_label"]) for r in moved.collect()} == {("t1", 1, "one"), ("t2", 1, "one"), ("t3", 1, "one"), ("t4", 2, "other")}
    got = {(r["run_id"], r["cluster_id"]): (r["size"], r["gap_flag"]) for r in mg.merge_clusters(c, moved, m).collect()}
    assert got == {("r", 1): (3, "CRITICAL"), ("r", 2): (0, "DUPLICATE"), ("s", 2): (1, "COVERED")}


def test_cut_keeps_rows_and_types(spark):
    df = spark.range(5).select("id", F.array(F.lit(1.5)).alias("v"), F.struct("id").alias("s"))
    again = cut(df)
    assert again.dtypes == df.dtypes and again.count() == 5


def test_numbered_is_the_place_in_key_order(spark):
    rnd = random.Random(4)
    keys = rnd.sample(range(1000), 300)
    df = spark.createDataFrame([(k % 7, k) for k in keys], "a long, b long").repartition(5)
    want = {k: i for i, k in enumerate(sorted(keys, key=lambda k: (k % 7, k)))}
    assert {r["b"]: r["n"] for r in numbered(df, ["a", "b"], "n").collect()} == want
    assert numbered(df.limit(0), ["a"], "n").isEmpty()
