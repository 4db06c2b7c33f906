"""Approximate search over a neighbour graph: an edge table built by joins of neighbours' neighbours, and a beam search.

*Building.* Every row starts with its nearest rows inside two hashed tiles. In a round the neighbours
of a row, forwards and backwards, are candidates for each other if one of the two edges is new.
Their vectors are sent to the neighbourhood and multiplied there; what leaves it are the pairs that
have room in a row's list. Every row keeps its ``degree`` best, and rounds end when hardly any edge
is new. A neighbourhood has ``2 * degree`` rows at most (of those that point to a
popular row a hashed choice counts), so no group grows with the table.

*Searching.* All queries go side by side. The best ``beam`` rows a query has met are rows of a table;
a round takes the best ``width`` of them that are not followed yet and sends the query to these
nodes, where it is multiplied with the vectors of their mates. It ends when no query has a row to
follow. Neither the graph nor the index is collected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gapscope.config import SIM_DIGITS
from gapscope.functions.vectors import normalise
from gapscope.operators.minibatch import matrix
from gapscope.operators.rounds import cut, drop_table
from gapscope.operators.similarity import Side, top_k

TILE_ROWS, LEAST_NEW = 64, 0.01
#: Rows with a vector in a group of neighbourhoods, and queries of one node compared at a time.
GROUP_ROWS, TURN_ROWS = 4096, 2048
#: Rows that searches begin from, in square roots of the table: groups that no edge joins are met there.
PIVOTS = 4


@dataclass
class Graph:
    """``nodes``: node, unit. ``edges``: node, mate, sim: the ``degree`` best mates found of every node."""

    nodes: DataFrame
    edges: DataFrame
    degree: int

    def drop(self) -> None:
        drop_table(self.nodes.sparkSession, self.nodes, self.edges)


def beside(hood: DataFrame, nodes: DataFrame, known: DataFrame, degree: int) -> DataFrame:
    """(node, mate, sim): of the rows of each neighbourhood, each other's ``degree`` best that may enter their lists.

    ``hood`` (node, mate, new) names the rows beside a node, ``known`` (node, least) the cosine a full list ends with.
    One of a pair is new. Vectors go to the neighbourhoods, some of which are one task's group; pairs that
    no list has room for do not leave it.
    """
    live = hood.where("new").select("node").distinct()
    members = hood.join(live, "node", "left_semi").join(known.withColumnRenamed("node", "mate"), "mate", "left")
    members = members.join(nodes.select(F.col("node").alias("mate"), "unit"), "mate")
    grouped = members.select(F.pmod(F.xxhash64("node"), F.lit(groups_of(hood))).alias("part"), "node", "mate", "new", F.coalesce("least", F.lit(-2.0)).alias("least"), "unit")
    kind = hood.schema["mate"].dataType
    out = T.StructType([T.StructField("node", kind), T.StructField("mate", kind), T.StructField("sim", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("node", "ascending"), ("mate", "ascending")]).combine_chunks()
        unit, new, least = matrix(table["unit"]), table["new"].to_numpy(), table["least"].to_numpy()
        owners = table["node"].combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.diff(owners, prepend=-1))
        one, two, sims = [], [], []
        for low, high in zip(starts, [*starts[1:], len(owners)]):
            fresh = new[low:high]
            sim = cosines(unit[low:high], unit[low:high])
            fit = (fresh[:, None] | fresh) & (sim >= least[low:high, None])
            np.fill_diagonal(fit, False)
            shown = np.where(fit, sim, -np.inf)
            # Equal cosines go to the lower mate, as members are sorted.
            place = np.argsort(-shown, axis=1, kind="stable")[:, :degree]
            row = np.repeat(np.arange(high - low), place.shape[1])
            keep = fit[row, place.ravel()]
            one.append(row[keep] + low)
            two.append(place.ravel()[keep] + low)
            sims.append(sim[one[-1] - low, two[-1] - low])
        mates = table["mate"].combine_chunks()
        return pa.table([mates.take(pa.array(np.concatenate(one))), mates.take(pa.array(np.concatenate(two))), pa.array(np.concatenate(sims))], schema=arrow)

    found = grouped.groupBy("part").applyInArrow(compare, out)
    return found.groupBy("node", "mate").agg(F.max("sim").alias("sim"))


def cosines(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.round(one @ two.T, SIM_DIGITS) + 0.0


def groups_of(rows: DataFrame) -> int:
    """So many groups by hash that one holds about ``GROUP_ROWS`` rows."""
    return max(1, rows.count() // GROUP_ROWS)


def units(side: Side, name: str) -> DataFrame:
    vector = F.col(side.vector).cast("array<double>")
    return side.frame.where(F.col(side.vector).isNotNull()).select(F.col(side.columns[0]).alias(name), normalise(vector).alias("unit"))


def first_of(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("__r", place).where(F.col("__r") <= n).drop("__r")


def build(index: Side, degree: int = 16, tile_rows: int = TILE_ROWS, least_new: float = LEAST_NEW) -> Graph:
    """The neighbour graph of an index whose ids are unique; rows without a vector are left out."""
    nodes = cut(units(index, "node"))
    spark, total = nodes.sparkSession, nodes.count()
    best = [F.desc("sim"), F.col("mate")]

    def in_tiles(seed: int) -> DataFrame:
        tiled = nodes.select("node", "unit", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(max(1, total // tile_rows))).alias("tile"))
        mates = tiled.select(F.col("node").alias("mate"), F.col("unit").alias("mate_unit"), "tile")
        return top_k(Side(tiled, "unit", ["node"]), Side(mates, "mate_unit", ["mate"]), degree // 2 + 1, by=["tile"]).where("node <> mate").select("node", "mate", "sim")

    # Two tilings, as no chain of neighbours leaves the tiles of one.
    start = in_tiles(1).unionByName(in_tiles(2)).distinct()
    edges = cut(first_of(start.withColumn("new", F.lit(True)), "node", best, degree))
    # Two rows on either side of a node; the mates of one row are as many as the degree allows.
    while edges.where("new").count() > least_new * total * degree:
        back = first_of(edges.select(F.col("mate").alias("node"), F.col("node").alias("mate"), "new"), "node", [F.desc("new"), F.xxhash64("mate", "node")], degree)
        hood = cut(edges.select("node", "mate", "new").unionByName(back).groupBy("node", "mate").agg(F.max("new").alias("new")))
        full = F.when(F.count("*") >= degree, F.min("sim")).alias("least")
        found = cut(beside(hood, nodes, edges.groupBy("node").agg(full), degree))
        # A pair that is known from one end is offered to the other end too.
        turned = edges.select(F.col("mate").alias("node"), F.col("node").alias("mate"), "sim", F.lit(True).alias("new"))
        merged = edges.withColumn("new", F.lit(False)).unionByName(turned).unionByName(found.withColumn("new", F.lit(True)))
        merged = merged.groupBy("node", "mate").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
        after = cut(first_of(merged, "node", best, degree))
        drop_table(spark, edges, hood, found)
        edges = after
    return Graph(nodes, edges, degree)


def beside_queries(follow: DataFrame, asked: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, node, sim): the mates of the nodes each query follows that reach ``least``, the end of its list.

    ``follow`` has node, query, least. The queries at a node meet the vectors of its mates in one group's product.
    """
    groups = groups_of(follow)
    part = F.pmod(F.xxhash64("at"), F.lit(groups)).alias("part")
    live = follow.select(F.col("node").alias("at")).distinct()
    ahead = links.withColumnRenamed("node", "at").join(live, "at", "left_semi").join(nodes.select(F.col("node").alias("mate"), "unit"), "mate").select(part, "at", "mate", "unit")
    come = follow.withColumnRenamed("node", "at").join(asked, "query").select(part, "at", "query", "least", "unit")
    out = T.StructType([asked.schema["query"], T.StructField("node", nodes.schema["node"].dataType), T.StructField("sim", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        left, right = left.sort_by("at").combine_chunks(), right.sort_by("at").combine_chunks()
        names = pa.concat_arrays([left["at"].combine_chunks(), right["at"].combine_chunks()]).dictionary_encode().indices.to_numpy()
        own, other = names[: left.num_rows], names[left.num_rows :]
        starts = np.flatnonzero(np.diff(other, prepend=-1))
        stretch = {int(other[low]): (low, high) for low, high in zip(starts, [*starts[1:], len(other)])}
        one, two, least = matrix(left["unit"]), matrix(right["unit"]), left["least"].to_numpy()
        lefts, rights, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        for low, high in zip(starts, [*starts[1:], len(own)]):
            if (at := stretch.get(int(own[low]))) is None:
                continue
            for i in range(low, high, TURN_ROWS):
                sim = cosines(one[i : min(high, i + TURN_ROWS)], two[at[0] : at[1]])
                li, ri = np.nonzero(sim >= least[i : min(high, i + TURN_ROWS), None])
                lefts.append(li + i)
                rights.append(ri + at[0])
                sims.append(sim[li, ri])
        return pa.table([left["query"].take(pa.array(np.concatenate(lefts))), right["mate"].take(pa.array(np.concatenate(rights))), pa.array(np.concatenate(sims))], schema=arrow)

    return come.groupBy("part").cogroup(ahead.groupBy("part")).applyInArrow(compare, out)


def met(queries: Side, graph: Graph, beam: int = 32, width: int = 8, entries: int = 8, keep: int | None = None) -> DataFrame:
    """(query, node, sim): the ``keep`` best rows, ``beam`` at least, of those each query was compared with.

    A row that is not among them can neither be followed later nor come back, so nothing else is stored.
    """
    spark, keep = graph.nodes.sparkSession, max(beam, keep or 0)
    asked = cut(units(queries, "query"))
    total = graph.nodes.count()
    pivots = graph.nodes.orderBy(F.xxhash64("node"), "node").limit(max(entries, PIVOTS * math.isqrt(total)))
    back = first_of(graph.edges.select(F.col("mate").alias("node"), F.col("node").alias("mate"), "sim"), "node", [F.desc("sim"), F.col("mate")], 2 * graph.degree)
    links = cut(graph.edges.select("node", "mate").unionByName(back.select("node", "mate")).distinct())
    start = top_k(Side(asked, "unit", ["query"]), Side(pivots, "unit", ["node"]), entries)
    seen = cut(start.select("query", "node", "sim", F.lit(False).alias("done")))
    best = [F.desc("sim"), F.col("node")]
    while True:
        near = first_of(seen, "query", best, beam).where("not done")
        full = seen.groupBy("query").agg(F.when(F.count("*") >= keep, F.min("sim")).otherwise(-2.0).alias("least"))
        follow = cut(first_of(near, "query", best, width).select("query", "node").join(full, "query"))
        if follow.isEmpty():
            break
        scored = beside_queries(follow, asked, links, graph.nodes).withColumn("done", F.lit(False))
        now = follow.select("query", "node", F.lit(-2.0).alias("sim"), F.lit(True).alias("done"))
        merged = seen.unionByName(now).unionByName(scored).groupBy("query", "node").agg(F.max("sim").alias("sim"), F.max("done").alias("done"))
        after = cut(first_of(merged, "query", best, keep))
        drop_table(spark, seen, follow)
        seen = after
    drop_table(spark, asked, links)
    return seen.drop("done")


def search(queries: Side, graph: Graph, k: int, *, beam: int = 32, width: int = 8, entries: int = 8) -> DataFrame:
    """query, node, sim, rank: the ``k`` best rows found per query, ties to the lower node."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "node"))
    return met(queries, graph, beam, width, entries, k).withColumn("rank", place).where(F.col("rank") <= k)
