import numpy as np
import pytest
from pyspark.sql import functions as F

from gapscope.operators import clustering as cl
from gapscope.operators import labelling as lb
from gapscope.operators import similarity as sm


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(11)
    centre = np.eye(4)[:3] * 5
    rows = []
    for c in range(3):
        for v in rng.normal(size=(40, 4)) * 0.3 + centre[c]:
            rows.append((len(rows), c, [float(x) for x in v / np.linalg.norm(v)]))
    return spark.createDataFrame(rows, "id long, truth int, v array<double>").cache()


def test_kmeans_finds_the_blobs_and_repeats(blobs):
    runs = []
    for _ in range(2):
        out = cl.kmeans(blobs, "v", 3, tries=3, max_iter=30)
        runs.append({r["id"]: r["cluster_id"] for r in out.collect()})
        groups = out.groupBy("truth").agg(F.count_distinct("cluster_id").alias("n")).collect()
        assert [g["n"] for g in groups] == [1, 1, 1]
    assert runs[0] == runs[1]


def test_sweep_and_choice(blobs):
    swept = cl.choose_k(cl.sweep(blobs, "v", (2, 3, 6, 500), tries=2, max_iter=20)).collect()
    by_k = {r["k"]: r for r in swept}
    assert by_k[500]["silhouette"] == -1.0 and by_k[500]["max_share"] == 1.0 and by_k[500]["inertia"] == float("inf")
    assert by_k[2]["inertia"] > by_k[3]["inertia"] > by_k[6]["inertia"]
    assert sum(r["is_best_k"] for r in swept) == 1


def test_choose_k_takes_the_first_on_ties(spark):
    s = spark.createDataFrame([(10, 0.5, 0.05), (20, 0.5, 0.1), (30, 0.6, 0.2)], "k int, silhouette double, max_share double")
    assert [r["k"] for r in cl.choose_k(s).where("is_best_k").collect()] == [10]


@pytest.mark.parametrize("layout", [{}, {"broadcast_bytes": 0, "block_rows": 16}])
def test_split_oversize(blobs, layout):
    small = F.floor(F.col("id") / 10)  # the last blob lies in four small clusters
    one = blobs.withColumn("cluster_id", F.when(F.col("truth") == 2, small).otherwise(0).cast("long"))
    out = cl.split_oversize(one, "id", "v", floor=50, target=40, **layout)
    rows = out.collect()
    assert len(rows) == 120 and out.columns == one.columns
    ids = sorted({r["cluster_id"] for r in rows})
    assert ids == list(range(len(ids))) and len(ids) == 6
    assert len({r["cluster_id"] for r in rows if r["truth"] == 2}) == 4  # small clusters untouched
    parts = {r["cluster_id"] for r in rows if r["truth"] != 2}
    assert len(parts) == 2 and min(parts) == 0 and max(parts) == 5  # the new part comes last
    assert cl.split_oversize(one, "id", "v", floor=100, target=40).agg(F.max("cluster_id")).first()[0] == 4


def parts_and_fit(spark, vectors, parts, **fit):
    """Similarities to the parts' means, own parts and mean similarity; two clusters of one row keep the bound low."""
    rows = [(i, 0, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(-1, 1, [-1.0] * len(vectors[0])), (-2, 2, [-1.0] * len(vectors[0]))]
    df = spark.createDataFrame(rows, "id long, cluster_id long, v array<double>").coalesce(1)
    out = [r for r in cl.split_oversize(df, "id", "v", floor=20, target=len(vectors) / parts, **fit).collect() if r["id"] >= 0]
    v, (names, own) = np.array([r["v"] for r in out]), np.unique([r["cluster_id"] for r in out], return_inverse=True)
    means = np.array([v[own == i].mean(axis=0) for i in range(len(names))])
    sims = v @ (means / np.linalg.norm(means, axis=1, keepdims=True)).T
    return sims, own, sims[np.arange(len(own)), own].mean()


def test_split_goes_on_until_every_row_is_with_its_nearest_mean(spark):
    angle = np.linspace(0, 1, 80) ** 3 * np.pi
    sims, own, _ = parts_and_fit(spark, np.stack([np.cos(angle), np.sin(angle)], axis=1), 4)
    assert (sims.max(axis=1) - sims[np.arange(len(own)), own]).max() < 1e-8


def test_split_keeps_the_best_of_its_starts(spark):
    rng = np.random.default_rng(3)
    v = np.repeat(np.eye(6), 8, axis=0) * 5 + rng.normal(size=(48, 6)) * 0.3
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    single = [parts_and_fit(spark, v, 6, tries=1, seed=cl.SEED + s)[2] for s in range(3)]
    best = parts_and_fit(spark, v, 6, tries=3)[2]
    assert max(single) - min(single) > 1e-6 and best == pytest.approx(max(single), abs=1e-8)


def test_oversize_bound(spark):
    s = spark.createDataFrame([(1,), (2,), (5,), (100,)], "size long")
    assert cl.oversize_bound(s, 4).first()["max_size"] == 6  # median 3.5, cut to 3, doubled
    assert cl.oversize_bound(s, 500).first()["max_size"] == 500


def test_renumber(spark):
    df = spark.createDataFrame([("a", 3), ("a", 9), ("a", 3), ("b", 7)], "run_id string, cluster_id long")
    got = sorted((r["run_id"], r["cluster_id"]) for r in cl.renumber(df, ["run_id"]).collect())
    assert got == [("a", 0), ("a", 0), ("a", 1), ("b", 0)]


def test_centroids_and_coherence(blobs):
    c = cl.centroids(blobs, "v", ["truth"])
    rows = blobs.collect()
    for r in c.collect():
        want = np.mean([x["v"] for x in rows if x["truth"] == r["truth"]], axis=0)
        assert r["centroid"] == pytest.approx(list(want))
    for r in cl.intra_similarity(blobs, "v", c, ["truth"]).collect():
        m = np.array([x["v"] for x in rows if x["truth"] == r["truth"]])
        d = m.mean(axis=0) / np.linalg.norm(m.mean(axis=0))
        assert r["intra_sim"] == pytest.approx(float((m @ d).mean()))


@pytest.mark.parametrize("layout", [{}, {"broadcast_bytes": 0, "block_rows": 32}])
def test_silhouette_by_hand(blobs, layout):
    rows = blobs.orderBy("id").collect()
    v, c = np.array([r["v"] for r in rows]), np.array([r["truth"] for r in rows])
    d = np.sqrt(np.maximum(0, 2 - 2 * v @ v.T))
    want = []
    for i in range(len(v)):
        a = d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(d[i, c == o].mean() for o in range(3) if o != c[i])
        want.append((b - a) / max(a, b))
    out = cl.euclidean_silhouette(blobs.withColumnRenamed("truth", "cluster_id"), "id", "v", **layout).orderBy("id").collect()
    assert [r["silhouette"] for r in out] == pytest.approx(want, abs=1e-4)


def test_lonely_point_has_silhouette_zero(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 1, [0.1, 1.0])], "id long, cluster_id int, v array<double>")
    got = {r["id"]: r["silhouette"] for r in cl.euclidean_silhouette(df, "id", "v").collect()}
    assert got[1] == 0.0 and got[2] > 0.5


def test_projection(blobs):
    c = cl.centroids(blobs, "v", ["truth"])
    p = cl.project_2d(c).collect()
    m = np.array([r["centroid"] for r in p])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    u, s, _ = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
    assert np.abs([r["pca_x"] for r in p]) == pytest.approx(np.abs(u[:, 0] * s[0]), abs=1e-8)
    assert np.abs([r["pca_y"] for r in p]) == pytest.approx(np.abs(u[:, 1] * s[1]), abs=1e-8)


def test_approximate_search_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    q = sm.Side(e.select(F.col("vec_id").alias("q"), "v"), "v", ["q"])
    i = sm.Side(e.select(F.col("vec_id").alias("k"), "v"), "v", ["k"])
    exact = {(r["q"], r["k"]) for r in sm.top_k(q, i, 5).collect()}
    near = {(r["q"], r["k"]) for r in cl.approximate_top_k(q, i, 5, lists=10, probes=6).collect()}
    assert len(near & exact) / len(exact) > 0.75
    every = {(r["q"], r["k"]) for r in cl.approximate_top_k(q, i, 5, lists=4, probes=4).collect()}
    assert every == exact


def test_terms_and_labels(spark):
    docs = spark.createDataFrame(
        [(1, 0, "Printer jam printer"), (2, 0, "printer jam"), (3, 1, "wifi down"), (4, 1, "wifi down again"), (5, 2, "")], "id long, cluster_id long, t string"
    )
    counts = lb.term_counts(docs, "id", "t", None, ["again"])
    terms = {(r["id"], r["term"]): r["tf"] for r in counts.collect()}
    assert terms[(1, "printer")] == 2 and terms[(1, "jam printer")] == 1 and (4, "down again") not in terms
    vocab = lb.vocabulary(counts, docs, min_docs=2)
    assert {r["term"]: r["df"] for r in vocab.collect()} == {"printer": 2, "jam": 2, "printer jam": 2, "wifi": 2, "down": 2, "wifi down": 2}
    w = lb.tfidf(counts, vocab, "id")
    got = {r["term"]: r["weight"] for r in w.where("id = 1").collect()}
    idf = np.log(6 / 3) + 1
    raw = {"printer": (1 + np.log(2)) * idf, "jam": idf, "printer jam": idf}
    length = np.sqrt(sum(x * x for x in raw.values()))
    assert got == pytest.approx({k: v / length for k, v in raw.items()})
    named = {r["cluster_id"]: (r["cluster_label"], r["top_terms"]) for r in lb.labels(lb.cluster_terms(w, docs), docs).collect()}
    assert named[0] == ("printer / jam", "printer, jam") and named[2] == ("Cluster_2", "")


def test_distinct_terms(spark):
    df = spark.createDataFrame([(["a b", "a", "b c", "c", "d"],)], "t array<string>")
    assert df.select(lb.distinct_terms(F.col("t")).alias("k")).first()["k"] == ["a b", "b c", "d"]
    assert df.select(lb.distinct_terms(F.col("t"), 2).alias("k")).first()["k"] == ["a b", "b c"]


def test_starts_are_fitted_side_by_side(spark, blobs):
    context = spark.sparkContext

    def jobs(tries):
        context.setJobGroup(f"starts-{tries}", "")
        cl.kmeans(blobs, "v", 3, tries=tries, max_iter=2).count()
        context.setLocalProperty("spark.jobGroup.id", None)
        return len(context.statusTracker().getJobIdsForGroup(f"starts-{tries}"))

    assert jobs(6) <= jobs(1) + 4
