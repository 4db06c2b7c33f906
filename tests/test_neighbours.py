"""Neighbour graph and beam search: recall against exact search, and small or odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapscope.operators import clustering as cl
from gapscope.operators import neighbours as nb
from gapscope.operators import similarity as sm
from gapscope.operators.rounds import cut
from gapscope.queries import coverage
from gapscope.queries.roles import Tables


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_registered_queries(spark, sf):
    """Shares of the exact five best; 184 and 675 rows of 64 nearly even dimensions leave little to skip."""
    t = Tables(spark, f"/root/testdata/sf{sf}")
    exact = {(r.ticket_id, r.kb_id) for r in sm.top_k(coverage.ticket_side(t), coverage.kb_side(t), 5).collect()}
    lists = {(r.ticket_id, r.kb_id) for r in coverage.approximate_top_k(t).collect()}
    assert len(lists & exact) >= 0.9 * len(exact) == 0.9 * len(lists)
    graph = {(r.ticket_id, r.kb_id) for r in coverage.neighbour_search(t).collect()}
    assert len(graph & exact) >= 0.95 * len(exact) == 0.95 * len(graph)


def test_few_rows_are_compared_where_rows_lie_in_groups(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 16)) * 2
    rows = [(k, [float(x) for x in centre[0 if k % 3 == 0 else k % 40] + rng.normal(size=16)]) for k in range(4000)]  # a third around one centre
    df = cut(spark.createDataFrame(rows, "id long, v array<double>").repartition(4))
    index = sm.Side(df.where("id % 8 <> 0"), "v", ["id"])
    queries = sm.Side(df.where("id % 8 = 0"), "v", ["id"])
    graph = nb.build(index)
    exact_edges = sm.top_k(sm.Side(index.frame.withColumnRenamed("id", "node"), "v", ["node"]), sm.Side(index.frame.withColumnRenamed("id", "mate"), "v", ["mate"]), 17).where("node <> mate")
    true = {(r.node, r.mate) for r in exact_edges.collect()}
    assert len({(r.node, r.mate) for r in graph.edges.collect()} & true) >= 0.9 * len(true)
    found = cut(nb.met(queries, graph))
    assert found.count() <= 0.15 * 500 * 3500 and found.count() == found.select("query", "node").distinct().count()
    exact = {(r.q, r["id"]) for r in sm.top_k(sm.Side(queries.frame.withColumnRenamed("id", "q"), "v", ["q"]), index, 5).collect()}
    got = {(r.query, r.node) for r in nb.first_of(found, "query", [F.desc("sim"), F.col("node")], 5).collect()}
    assert len(got & exact) >= 0.95 * len(exact)


def test_odd_inputs(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 2.0]), ("d", None), ("e", [0.0, 0.0])], "id string, v array<double>")
    side = sm.Side(df, "v", ["id"])
    graph = nb.build(side, degree=3)
    assert {r.node for r in graph.edges.collect()} == set("abce")
    got = {(r.query, r["rank"]): (r.node, r.sim) for r in nb.search(side, graph, 2).collect()}
    assert got["a", 1] == ("a", 1.0) and got["a", 2] == ("b", 1.0) and got["c", 1] == ("c", 1.0) and not any(q == "d" for q, _ in got)
    graph.drop()
    empty = nb.build(sm.Side(df.limit(0), "v", ["id"]))
    assert nb.search(side, empty, 2).count() == 0
    one = nb.build(sm.Side(df.limit(1), "v", ["id"]))
    assert nb.search(side, one, 2).count() == 4 and nb.search(sm.Side(df.limit(0), "v", ["id"]), one, 2).count() == 0


def test_what_is_stored_grows_with_rows_not_with_comparisons(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = cut(spark.createDataFrame([(k, [float(x) for x in rng.normal(size=32)]) for k in range(1200)], "id long, v array<double>").repartition(4))
    side, stored = sm.Side(df, "v", ["id"]), []

    def counted(table):
        out = cut(table)
        stored.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(nb, "cut", counted)
    graph = nb.build(side, degree=8)
    pairs = [n for columns, n in stored if columns == ["node", "mate", "sim"]]
    assert max(pairs[1:]) < 1200 * 8 * 4  # a row has room for 8
    found = nb.met(side, graph, beam=16)
    assert found.groupBy("query").count().agg(F.max("count")).first()[0] == 16
    assert max(n for columns, n in stored if columns == ["query", "node", "sim", "done"]) <= 1200 * 16
