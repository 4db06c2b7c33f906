"""Centres of a split pass the driver up to a bound, whatever the number of rounds."""

import pytest
from pyspark.sql import functions as F

from gapscope.operators import clustering as cl


@pytest.fixture(scope="module")
def rows(spark):
    vec = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.sin(i * (F.col("id") % 7 + 1)) + F.sin(F.col("id") * i) / 3)
    return spark.range(260).select("id", vec.alias("v"), F.when(F.col("id") < 200, 0).otherwise(1 + F.col("id") % 3).cast("int").alias("cluster_id"))


def test_centres_beyond_the_bound_are_shuffled_with_the_same_parts(rows, monkeypatch):
    sent = []

    def seen(left, right, *args, broadcast_bytes, **rest):
        size = cl.bytes_of(right.slim(["cluster_id"]))[0]
        sent.append(size if size <= broadcast_bytes else 0)
        return compare(left, right, *args, broadcast_bytes=broadcast_bytes, **rest)

    compare = cl.compare
    monkeypatch.setattr(cl, "compare", seen)
    found = {}
    for bound in (1 << 30, 5000):
        monkeypatch.setattr(cl, "SENT_BYTES", bound)
        sent.clear()
        out = cl.split_oversize(rows, "id", "v", floor=50, target=40, tries=2, max_iter=5)
        found[bound] = sorted((r.id, r.cluster_id) for r in out.collect())
        assert sum(sent) <= bound and len(sent) > 1
        assert (0 in sent) == (bound == 5000) and sum(sent) > 0
    assert found[1 << 30] == found[5000] and len({c for _, c in found[5000]}) > 4
