"""Terms of documents, counted in the row."""

from collections import Counter

from pyspark.sql import functions as F

from gapscope.operators import labelling as lb


def test_terms_are_counted_and_no_comparator_is_interpreted(spark):
    texts = ["tok tok tok end tok tok", "", None, "x y", "solo", "end " * 3000 + "tok"]
    docs = spark.createDataFrame([(k, 7, t) for k, t in enumerate(texts)], "id long, cluster_id long, t string")
    got = {(r.id, r.cluster_id, r.term): r.tf for r in lb.term_counts(docs, "id", "t", None, ["stop"], {}).collect()}
    want = {}
    for k, t in enumerate(texts):
        words = [w for w in (t or "").split() if len(w) > 2]
        want |= {(k, 7, term): n for term, n in Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]).items()}
    assert got == want
    plan = docs.select(lb.term_runs(F.split("t", " ")))._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan
