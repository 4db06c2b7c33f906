import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pruned import shuffled_rows

from gapscope.functions import vectors as vc
from gapscope.operators import quantiles, rounds
from gapscope.operators import similarity as sm
from gapscope.operators.quantiles import pairs_above_percentile, similarity_percentile
from gapscope.plans import coverage as cv
from gapscope.plans import review as rv
from gapscope.queries import gaps
from gapscope.queries.roles import Tables

LAYOUTS = (
    {}, {"block_rows": 7}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "block_rows": 7}, {"broadcast_bytes": 0, "block_rows": 7, "chunk_bytes": 0},
)


@pytest.fixture(scope="module")
def sets(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(60, 6))
    b = rng.normal(size=(41, 6))
    b[7] = b[3]  # a tie
    a[5] = 0.0  # a zero vector
    left = spark.createDataFrame(
        [(i, "x" if i % 3 else "y", None if i == 9 else [float(v) for v in r]) for i, r in enumerate(a)], "t long, g string, v array<double>"
    )
    right = spark.createDataFrame(
        [(i, "x" if i % 2 else "y", None if i == 4 else [float(v) for v in r]) for i, r in enumerate(b)], "k long, g string, v array<double>"
    )
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) > 0, np.linalg.norm(m, axis=1, keepdims=True), 1)
    return left, right, np.round(unit(a) @ unit(b).T, 9)


def brute(sim, k, grouped):
    out = {}
    for t in range(sim.shape[0]):
        if t == 9:
            continue
        mates = [j for j in range(sim.shape[1]) if j != 4 and (not grouped or ("x" if t % 3 else "y") == ("x" if j % 2 else "y"))]
        out[t] = sorted(mates, key=lambda j: (-sim[t, j], j))[:k]
    return out


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("grouped", [False, True])
def test_top_k_equals_brute_force(sets, layout, grouped):
    left, right, sim = sets
    for k in (1, 4):
        got = {}
        hits = sm.top_k(sm.Side(left, "v", ["t"]), sm.Side(right, "v", ["k"]), k, by=["g"] if grouped else [], **layout)
        for r in hits.collect():
            got.setdefault(r["t"], {})[r["rank"]] = r["k"]
            assert abs(r["sim"] - sim[r["t"], r["k"]]) < 1e-8
        assert {t: [v[i] for i in sorted(v)] for t, v in got.items()} == brute(sim, k, grouped)


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("k", [1, 4])
def test_top_k_with_struct_and_repeated_leads(sets, layout, k):
    left, right, sim = sets
    both = left.withColumn("c", F.struct((F.col("t") % 5).alias("r"), "g")).withColumn("other", F.col("t").cast("string"))
    got = {}
    hits = sm.top_k(sm.Side(both, "v", ["c", "other"]), sm.Side(right, "v", ["k"]), k, **layout)
    for r in hits.collect():
        assert r["c"]["r"] == int(r["other"]) % 5
        got.setdefault(int(r["other"]), {})[r["rank"]] = r["k"]
    assert {t: [v[i] for i in sorted(v)] for t, v in got.items()} == brute(sim, k, False)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_plans_agree_in_every_layout(spark, sets, layout):
    left, right, sim = sets
    tickets = left.select(F.col("t").alias("ticket_id"), F.lit(None).cast("array<double>").alias("res_vec"), F.col("v").alias("problem_vec"))
    kb = right.select(F.col("k").alias("kb_id"), F.concat(F.lit("title "), "k").alias("title"), F.lit("text").alias("solution"), F.col("v").alias("kb_vec"))
    found = {r["ticket_id"]: r["best_kb_id"] for r in cv.ticket_coverage(tickets, kb, **layout).collect()}
    assert found == {t: v[0] for t, v in brute(sim, 1, False).items()}
    clusters = left.select(F.lit("run").alias("run_id"), F.col("t").alias("cluster_id"), F.col("v").alias("centroid"))
    got = {}
    for r in rv.candidates(clusters, kb, **layout).collect():
        got.setdefault(r["cluster_id"], {})[r["rank"]] = r["kb_id"]
    assert {t: [v[i] for i in sorted(v)] for t, v in got.items()} == brute(sim, 10, False)
    members = left.select("t", (F.col("t") % 7).alias("cluster_id"), F.col("v").alias("cluster_vec"), F.col("v").alias("kb_side_vec")).where("v is not null")
    assert sorted(map(tuple, cv.cluster_summary(members, kb, **layout).drop("centroid", "kb_centroid").collect())) == sorted(
        map(tuple, cv.cluster_summary(members, kb).drop("centroid", "kb_centroid").collect())
    )


def test_coverage_without_articles(sets):
    left, right, _ = sets
    tickets = left.select(F.col("t").alias("ticket_id"), F.col("v").alias("res_vec"), F.col("v").alias("problem_vec"))
    kb = right.where("k < 0").select(F.col("k").alias("kb_id"), F.lit("t").alias("title"), F.col("v").alias("kb_vec"))
    out = cv.ticket_coverage(tickets, kb).collect()
    assert len(out) == 59 and {(r["max_kb_sim"], r["best_kb_id"], r["best_kb_title"], r["coverage"]) for r in out} == {(0.0, None, None, "UNCOVERED")}


@pytest.mark.parametrize("block", [5, 1000])
@pytest.mark.parametrize("chunk", [0, 1500, 1 << 20])
def test_pairs_above_equals_brute_force(sets, block, chunk):
    _, right, _ = sets
    rows = {r["k"]: np.array(r["v"]) for r in right.collect() if r["v"]}
    cos = lambda x, y: round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9)
    want = {(i, j) for i in rows for j in rows if i < j and cos(rows[i], rows[j]) > 0.5}
    assert {(r["a"], r["b"]) for r in sm.pairs_above(right, "k", "v", 0.5, block_rows=block, chunk_bytes=chunk).collect()} == want


def test_empty_right_side(sets):
    left, right, _ = sets
    none = right.where("k < 0")
    for layout in LAYOUTS:
        assert sm.nearest(sm.Side(left, "v", ["t"]), sm.Side(none, "v", ["k"]), **layout).count() == 0
    new = sm.novelty(
        sm.Side(left.withColumn("f", F.lit("CRITICAL")), "v", ["t", "f"]), sm.Side(none.withColumn("kb_title", F.lit("")), "v", ["k", "kb_title"]), "f"
    ).collect()
    assert len(new) == 59 and all(r["novelty_pass"] and r["max_existing_kb_sim"] == 0.0 and r["closest_existing_kb"] == "" for r in new)


def test_normalise_and_combine(spark):
    df = spark.createDataFrame(
        [(1, [3.0, 4.0], [0.0, 1.0]), (2, [0.0, 0.0], None), (3, None, [1.0, 0.0]), (4, None, None), (5, [0.6, 0.0], [-0.4, 0.0])],
        "i int, a array<double>, b array<double>",
    )
    out = df.orderBy("i").select(vc.normalise(F.col("a")).alias("n"), vc.combine(F.col("a"), F.col("b")).alias("c")).collect()
    assert out[0]["n"] == pytest.approx([0.6, 0.8]) and out[1]["n"] == [0.0, 0.0] and out[2]["n"] is None
    want = np.array([1.2, 2.2]) / np.linalg.norm([1.2, 2.2])
    assert out[0]["c"] == pytest.approx(list(want))
    assert out[1]["c"] == [0.0, 0.0] and out[2]["c"] == [1.0, 0.0] and out[3]["c"] is None
    assert out[4]["c"] == [0.6, 0.0]  # the two cancel out


def test_combine_with_equal_weights_is_symmetric(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.5, -1.0, 2.0])], "a array<double>, b array<double>")
    r = df.select(vc.combine(F.col("a"), F.col("b"), 0.5, 0.5).alias("x"), vc.combine(F.col("b"), F.col("a"), 0.5, 0.5).alias("y")).first()
    assert r["x"] == pytest.approx(r["y"])


def test_problem_vectors(spark):
    df = spark.createDataFrame([(True, [1.0], [2.0], [5.0])], "flag boolean, s array<double>, d array<double>, act array<double>")
    none = F.lit(None).cast("array<double>")
    s, d, act, flag = F.col("s"), F.col("d"), F.col("act"), F.col("flag")
    r = df.select(
        vc.incident_problem_vector(flag, s, d).alias("generic"), vc.incident_problem_vector(flag, s, none).alias("no_detail"),
        vc.incident_problem_vector(~flag, s, d).alias("both"), vc.workorder_problem_vector(flag, s, none, act).alias("template"),
        vc.workorder_problem_vector(~flag, s, none, act).alias("title"), vc.workorder_problem_vector(~flag, none, d, act).alias("none"),
    ).first()
    assert (r["generic"], r["no_detail"], r["both"], r["template"], r["title"], r["none"]) == ([2.0], [1.0], [1.0], [5.0], [1.0], None)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.75, 1.0])
def test_percentile_is_exact(spark, q):
    rng = np.random.default_rng(5)
    rows = [("a", round(float(v), 9)) for v in rng.uniform(-1, 1, 501)] + [("b", 0.25)] * 7 + [("c", -1.0), ("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["p"] for r in similarity_percentile(df, "v", q, ["g"], "p").collect()}
    for g in "abc":
        assert got[g] == pytest.approx(np.percentile([v for k, v in rows if k == g], q * 100), abs=1e-9)
    whole = similarity_percentile(df, "v", q, (), "p").first()["p"]
    assert whole == pytest.approx(np.percentile([v for _, v in rows], q * 100), abs=1e-9)


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("q", [0.0, 0.5, 0.75, 1.0])
def test_pairs_above_percentile_equals_brute_force(sets, layout, q):
    left, right, sim = sets
    got = {r["g"]: (r["pairs"], r["above"]) for r in pairs_above_percentile(sm.Side(left, "v", ["t", "g"]), sm.Side(right, "v", ["k"]), "g", q, **layout).collect()}
    own, met = [i for i in range(60) if i != 9], [j for j in range(41) if j != 4]
    bound = np.quantile(sim[np.ix_(own, met)], q)
    want = {}
    for g in "xy":
        rows = sim[np.ix_([i for i in own if ("x" if i % 3 else "y") == g], met)]
        want[g] = (rows.size, int((rows > bound).sum()))
    assert got == want
    assert pairs_above_percentile(sm.Side(left, "v", ["t", "g"]), sm.Side(right.limit(0), "v", ["k"]), "g", q, **layout).count() == 0


def test_percentile_of_every_pair_stores_no_pairs(spark, monkeypatch):
    t = Tables(spark, "/root/testdata/sf0.01")
    pairs, stored, cut = t.ticket_vectors().count() * t.kb().count(), [], rounds.cut

    def counted(df):
        out = cut(df)
        stored.append(out.count())
        return out

    for module in (quantiles, gaps):
        monkeypatch.setattr(module, "cut", counted, raising=False)
    assert gaps.coverage_scores_one_run(t).agg(F.sum("kb_count")).first()[0] == pairs
    assert sum(stored) < 0.5 * pairs


def test_a_row_is_sent_once_per_tile_not_per_block(spark):
    rng = np.random.default_rng(6)
    df = rounds.cut(spark.createDataFrame([(k, [float(x) for x in rng.normal(size=8)]) for k in range(3000)], "id long, v array<double>"))
    before = shuffled_rows(spark)
    best = sm.nearest(sm.Side(df, "v", ["id"]), sm.Side(df.withColumnRenamed("id", "mate"), "v", ["mate"]), broadcast_bytes=0, block_rows=16)
    assert best.where("id = mate").count() == 3000
    assert shuffled_rows(spark) - before < 3000 * 40  # 188 blocks
