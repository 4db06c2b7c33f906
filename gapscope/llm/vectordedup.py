"""Exact near-duplicate pairs of vectors by dual traversal of cover trees.

Unit vectors of cosine ``least`` lie at most ``reach`` = sqrt(2 - 2 least) apart, so links are
the pairs within a distance. A cover tree nests balls: a node's children cover its members with
balls of half its radius. Two trees are walked together: a pair of nodes whose balls are further
apart than the reach is cut off whole, a pair whose balls lie wholly within it is linked whole
without comparing members, and pairs of leaves are compared in double precision.

The top of the trees is laid out over Spark:

1. Equal vectors of a label are one point with a count. Its smallest vec_id stands for it.
2. A bounded, hashed sample gives pivots; every point goes to the cell of its nearest pivot.
   Cells know their exact covering radius per label.
3. A point also visits the cells of higher number that could hold a partner: the ball of the
   cell must reach it, and so must the side of the plane between the two pivots. This loses no
   pair and meets each pair of cells once.
4. Cells are cut into blocks of at most about ``block`` points, and each pair of blocks that
   can meet is one task's group, where a cover tree of either side is built and walked.

A task returns counts and a spanning forest of the links it found, never all pairs, and
components are found on those. A label or cell with a third of all rows becomes more blocks.

Links need equal labels that are not null. Vectors that are null, empty, zero or hold null or
non-finite components, and rows without a vec_id, link with nothing. Vectors of different sizes
never link. Rows of one vec_id and equal vectors are one vector. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscope.llm.common import cut
from gapscope.llm.components import components

LEAF = 48
BLOCK = 2048
MOST_PIVOTS = 1024


@dataclass
class Ball:
    """A node: its centre's row, its members' rows, its exact radius and the balls inside it."""

    centre: int
    rows: np.ndarray
    radius: float
    inside: list["Ball"]


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (points @ to.T), 0))


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, centre: int | None = None) -> Ball:
    """A tree over unit vectors. A node that halving would only scatter stays a leaf."""
    rows = np.arange(len(points)) if rows is None else rows
    centre = int(rows[0]) if centre is None else centre
    away = distances(points[rows], points[centre][None])[:, 0]
    radius = float(away.max())
    node = Ball(centre, rows, radius, [])
    if len(rows) <= LEAF or radius < 1e-6:
        return node
    half, left, parts = radius / 2, rows, []
    most = max(4, len(rows) // 8)
    pivot = centre
    while len(left):
        if len(parts) == most:
            return node  # no structure at this scale: comparing members outright is cheaper
        near = distances(points[left], points[pivot][None])[:, 0] <= half
        near[left == pivot] = True
        parts.append((pivot, left[near]))
        left = left[~near]
        pivot = int(left[0]) if len(left) else -1
    if len(parts) > 1:
        node.inside = [cover_tree(points, part, p) for p, part in parts]
    return node


class Forest:
    """Union-find over rows; the smaller root wins."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def walk(points: np.ndarray, weights: np.ndarray, first: Ball, second: Ball | None, least: float) -> tuple[np.ndarray, Forest]:
    """Links between two trees over rows of ``points`` (or inside one): per row the weight of its
    partners, and the components of the links."""
    reach, slack = math.sqrt(2 - 2 * least), 1e-7
    linked, forest = np.zeros(len(points), np.int64), Forest(len(points))
    todo = [(first, first if second is None else second)]
    while todo:
        x, y = todo.pop()
        same = x is y
        apart = 0.0 if same else float(distances(points[x.centre][None], points[y.centre][None])[0, 0])
        if apart > x.radius + y.radius + reach + slack:
            continue
        if (2 * x.radius if same else apart + x.radius + y.radius) < reach - slack:
            linked[x.rows] += weights[y.rows].sum() - (weights[x.rows] if same else 0)
            if not same:
                linked[y.rows] += weights[x.rows].sum()
            for r in (x.rows, y.rows):
                for k in r:
                    forest.union(int(x.rows[0]), int(k))
            continue
        if not x.inside and not y.inside:
            compare(points, weights, x.rows, y.rows, same, least, linked, forest)
        elif same:
            todo += [(a, b) for k, a in enumerate(x.inside) for b in x.inside[k:]]
        elif not y.inside or x.inside and x.radius >= y.radius:
            todo += [(a, y) for a in x.inside]
        else:
            todo += [(x, b) for b in y.inside]
    return linked, forest


def compare(points, weights, xs: np.ndarray, ys: np.ndarray, same: bool, least: float, linked: np.ndarray, forest: Forest) -> None:
    for k in range(0, len(xs), 1024):
        part = xs[k : k + 1024]
        hits = points[part] @ points[ys].T >= least
        if same:
            hits[np.arange(len(part)), np.arange(k, k + len(part))] = False
        linked[part] += hits @ weights[ys]
        if not same:
            linked[ys] += hits.T @ weights[part]
        for i in np.flatnonzero(hits.any(axis=1)):
            for j in ys[hits[i]]:
                forest.union(int(part[i]), int(j))


def sound(vector: Column) -> Column:
    """Whether a vector has a direction: not null, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def unit(array: np.ndarray) -> np.ndarray:
    # The largest component first, so that squares of very large or small numbers stay in range.
    array = array / np.abs(array).max(axis=1, keepdims=True)
    return array / np.sqrt((array * array).sum(axis=1, keepdims=True))


def matrix(vectors: pd.Series) -> np.ndarray:
    return unit(np.stack([np.asarray(v, np.float64) for v in vectors]))


POINT = "label long, width int, id long, weight long, vector array<double>"


def placed(points: DataFrame, pivots: np.ndarray, width: int, reach: float) -> DataFrame:
    """``points`` of one width with ``cell`` (nearest pivot) and ``away`` (distance to it)."""
    sent = points.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("cell int, away double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        d = distances(matrix(vectors), sent.value)
        return pd.DataFrame({"cell": d.argmin(axis=1).astype(np.int32), "away": d.min(axis=1)})

    return points.withColumn("__p", nearest("vector")).select("*", "__p.cell", "__p.away").drop("__p")


def links_of_width(points: DataFrame, width: int, least: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(id, n) partial counts and (a, b) forest links among points of one width."""
    spark = points.sparkSession
    reach = math.sqrt(2 - 2 * least)
    total = points.count()
    wanted = max(1, min(MOST_PIVOTS, total // block))
    sample = points.orderBy(F.xxhash64("id", "label"), "id", "label").limit(wanted).select("vector").toPandas()
    pivots = matrix(sample["vector"])
    cells = cut(placed(points, pivots, width, reach))
    balls = cells.groupBy("label", "cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    balls = cut(balls)
    # Per label the radius of each of its cells: at most MOST_PIVOTS entries.
    reaches = cut(balls.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("cell", "radius"))).alias("radii")))
    sent = spark.sparkContext.broadcast(pivots)

    @F.pandas_udf("array<int>")
    def visits(vectors: pd.Series, homes: pd.Series, radii: pd.Series) -> pd.Series:
        p = sent.value
        d = distances(matrix(vectors), p)
        between = distances(p, p)
        out = []
        for row, home, known in zip(d, homes, radii):
            others = np.array(sorted(c for c in dict(known) if c > home), np.int64)
            r = np.array([dict(known)[c] for c in others.tolist()])
            ball = row[others] <= r + reach + 1e-7 if len(others) else np.empty(0, bool)
            plane = row[others] ** 2 - row[home] ** 2 <= 2 * reach * between[home, others] + 1e-7 if len(others) else ball
            out.append(others[ball & plane].astype(np.int32).tolist())
        return pd.Series(out, dtype=object)

    guests = cells.join(reaches, "label").select("label", "id", "weight", "vector", F.explode(visits("vector", "cell", "radii")).alias("cell"))
    guests = cut(guests)
    numbers = balls.select("label", "cell", F.ceil(F.col("n") / block).cast("int").alias("own")).join(
        guests.groupBy("label", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("other")), ["label", "cell"], "left"
    )
    numbers = cut(numbers.select("label", "cell", "own", F.coalesce("other", F.lit(0)).alias("other")))
    hashed = lambda n: F.pmod(F.xxhash64("id", "cell"), F.col(n)).cast("int")
    at_home = cells.join(numbers, ["label", "cell"]).withColumn("s", hashed("own"))
    pairs = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda k: F.struct(F.least(k, F.col("s")).alias("i"), F.greatest(k, F.col("s")).alias("j"))),
        F.when(F.col("other") > 0, F.transform(F.sequence(F.lit(0), F.col("other") - 1), lambda k: F.struct(F.col("s").alias("i"), (F.col("own") + k).alias("j")))).otherwise(F.array()),
    )
    residents = at_home.select("label", "cell", "id", "weight", "vector", "s", F.explode(pairs).alias("g"))
    visiting = guests.join(numbers, ["label", "cell"]).withColumn("s", F.col("own") + hashed("other"))
    across = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda k: F.struct(k.alias("i"), F.col("s").alias("j")))
    visitors = visiting.select("label", "cell", "id", "weight", "vector", "s", F.explode(across).alias("g"))

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        i, j = key[2], key[3]
        group = group.sort_values("id", kind="stable")
        points, weights, ids = matrix(group["vector"]), group["weight"].to_numpy(np.int64), group["id"].to_numpy(np.int64)
        first, second = (np.flatnonzero(group["s"].to_numpy() == k) for k in (i, j))
        if not len(first) or not len(second):
            return pd.DataFrame({"id": [], "n": [], "root": []}).astype("int64")
        tree = cover_tree(points, first)
        linked, forest = walk(points, weights, tree, None if i == j else cover_tree(points, second), least)
        hit = np.flatnonzero(linked)
        return pd.DataFrame({"id": ids[hit], "n": linked[hit], "root": ids[[forest.root(int(k)) for k in hit]] if len(hit) else []}).astype("int64")

    met = residents.unionByName(visitors).select("label", "cell", F.col("g.i").alias("i"), F.col("g.j").alias("j"), "id", "weight", "vector", "s")
    found = cut(met.groupBy("label", "cell", "i", "j").applyInPandas(meet, "id long, n long, root long"))
    return found.select("id", "n"), found.where(F.col("id") != F.col("root")).select(F.col("id").alias("a"), F.col("root").alias("b"))


def dedup(vectors: DataFrame, least: float = 0.98, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    v = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound(v), F.lit(False))
    bare = F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))  # one zero
    marked = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.when(usable, bare).alias("vector"))
    keyed = marked.select("*", F.when(F.col("vector").isNotNull(), F.struct("label", F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b"))).alias("key"))
    keyed = cut(keyed)
    found = keyed.where(F.col("key").isNotNull())
    # Copies of a vector: how many there are, and the smallest id.
    copies = cut(found.select("key", "vec_id").distinct().groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    points = cut(
        found.join(copies, (found["key"] == copies["key"]) & (F.col("vec_id") == F.col("id")))
        .select(found["key"].alias("key"), "label", "id", "weight", "vector").dropDuplicates(["key"])
        .select("label", F.size("vector").alias("width"), "id", "weight", "vector")
    )
    counts = links = None
    # Vectors of a table have one width, or a few.
    for row in points.select("width").distinct().collect():
        n, l = links_of_width(points.where(F.col("width") == row["width"]), row["width"], least, block)
        counts, links = (n, l) if counts is None else (counts.union(n), links.union(l))
    summed = copies
    if counts is not None:
        summed = summed.join(counts.groupBy(F.col("id").alias("__id")).agg(F.sum("n").alias("n")), F.col("id") == F.col("__id"), "left").drop("__id")
        summed = summed.join(components(links), F.col("id") == F.col("node"), "left").drop("node")
    else:
        summed = summed.withColumns({"n": F.lit(0).cast("long"), "component_id": F.lit(None).cast("long")})
    known = cut(summed.select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")))
    out = keyed.select("vec_id", "key").join(known, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: The same by comparing every two vectors.
SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98
),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""
