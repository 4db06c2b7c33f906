"""What a cell of two tiles makes leaves its task block by block."""

import weakref

import numpy as np
from pyspark.sql import functions as F

from gapscope.operators import similarity as sm


def test_a_cell_holds_the_rows_of_few_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(80, 3)))]
    left, right = spark.createDataFrame(rows, "a long, v array<double>"), spark.createDataFrame(rows, "b long, v array<double>")

    def kernel(cell, made=[]):
        n, m = cell.sim.shape
        values = np.full(n * m, float(sum(r() is not None for r in made)))  # earlier blocks that are still held
        made.append(weakref.ref(values))
        return np.repeat(np.arange(n), m), np.tile(np.arange(m), n), {"sim": values}

    found = sm.compare(sm.Side(left, "v", ["a"]), sm.Side(right, "v", ["b"]), kernel, sm.SIM, broadcast_bytes=0, block_rows=5).rows
    seen = found.agg(F.count("*").alias("n"), F.count_distinct("a", "b").alias("pairs"), F.max("sim").alias("held")).first()
    assert seen["n"] == seen["pairs"] == 6400 and seen["held"] <= 3
