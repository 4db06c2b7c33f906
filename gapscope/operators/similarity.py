"""Comparing two sets of vectors by cosine, exactly and at any size.

``compare`` is the one primitive. It never forms a row pair in Spark: tasks
multiply a block of left vectors with a block of right vectors and return only
what the caller's kernel keeps. Two layouts, chosen by a measured size:

* the right side fits the broadcast bound: every task streams its left batches
  past the broadcast blocks, with no shuffle of the left side;
* it does not: both sides are cut into hashed tiles and each (left tile, right tile)
  cell is one group of rows, whose result leaves the task block by block. A row is sent once per tile of the other side, so
  tiles are as large as a task may hold, but a group is at least ``SPREAD`` of them if it
  has the blocks: no task gets a large share of a group, and a hot group spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gapscope.config import SIM_DIGITS, Thresholds
from gapscope.functions.text import gap_class
from gapscope.functions.vectors import dot, normalise

BLOCK_ROWS = 1024
BROADCAST_BYTES = 16 << 20
CHUNK_BYTES = 16 << 20
SPREAD = 16
VECTOR = "__vec"


@dataclass
class Cell:
    """One block of left rows against one block of right rows."""

    left: pa.Table
    right: pa.Table
    sim: np.ndarray
    diagonal: bool = False

    def left_values(self, name: str) -> np.ndarray:
        return self.left[name].to_numpy(zero_copy_only=False)

    def right_values(self, name: str) -> np.ndarray:
        return self.right[name].to_numpy(zero_copy_only=False)


# A kernel returns row numbers on the left, row numbers on the right (or None when
# its output is one row per left row) and the value columns.
Kernel = Callable[[Cell], tuple[np.ndarray, np.ndarray | None, dict[str, np.ndarray]]]


@dataclass(frozen=True)
class Side:
    """A frame, its vector column and the columns that travel with a row, id first."""

    frame: DataFrame
    vector: str
    columns: Sequence[str]

    def slim(self, by: Sequence[str]) -> DataFrame:
        wanted = list(dict.fromkeys([*by, *self.columns]))
        return self.frame.where(F.col(self.vector).isNotNull()).select(
            *wanted, F.col(self.vector).cast("array<double>").alias(VECTOR)
        )


def _unit_rows(table: pa.Table) -> np.ndarray:
    """Matrix of the vector column, rows scaled to length one; zero rows stay zero."""
    n = table.num_rows
    if n == 0:
        return np.zeros((0, 0))
    flat = table[VECTOR].combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays(flat.chunks).flatten()
    m = flat.to_numpy(zero_copy_only=False).reshape(n, -1)
    length = np.concatenate([np.sqrt((r * r).sum(axis=1, keepdims=True)) for r in np.array_split(m, 1 + n // BLOCK_ROWS)])
    return m / np.where(length > 0, length, 1.0)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sim = a @ b.T
    np.round(sim, SIM_DIGITS, out=sim)
    sim += 0.0
    return sim


AT, MATE = "__at", "__mate"


def _emit(cell: Cell, kernel: Kernel, left_cols, right_cols, schema: pa.Schema, first: int | None = None) -> pa.Table:
    """What the kernel keeps. ``first`` is the place of the block's first right row: with it,
    each row also tells which left row of the block and which right row it stems from."""
    li, ri, values = kernel(cell)
    data = {c: cell.left[c].take(pa.array(li)) for c in left_cols}
    if ri is not None:
        data.update({c: cell.right[c].take(pa.array(ri)) for c in right_cols})
    data.update(values)
    out = pa.table([pa.array(data[f.name], f.type) if isinstance(data[f.name], np.ndarray)
                    else data[f.name].cast(f.type) for f in schema], schema=schema)
    if first is None:
        return out
    mates = np.zeros(len(li), np.int64) if ri is None else np.asarray(ri) + first
    return out.append_column(AT, pa.array(np.asarray(li, np.int64))).append_column(MATE, pa.array(mates))


def _group_rows(table: pa.Table, by: Sequence[str]) -> dict[tuple, np.ndarray]:
    if not by:
        return {(): np.arange(table.num_rows)}
    groups = table.select(list(by)).to_pandas().groupby(list(by), dropna=False).indices
    return {k if isinstance(k, tuple) else (k,): np.sort(v) for k, v in groups.items()}


class Comparison(NamedTuple):
    """Rows a kernel kept. ``whole``: each left row met all its right rows in one task."""

    rows: DataFrame
    whole: bool


def compare(
    left: Side,
    right: Side,
    kernel: Kernel,
    values: T.StructType,
    *,
    by: Sequence[str] = (),
    per_left: bool = False,
    symmetric: bool = False,
    fold: Callable[[pa.Table], pa.Table] | None = None,
    block_rows: int = BLOCK_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> Comparison:
    """Run ``kernel`` on every block of left rows against every block of right rows.

    Only rows with equal ``by`` values meet. The result holds ``by``, the left
    columns, the right columns (unless ``per_left``) and ``values``. A left row
    comes out once per right block it met; ``fold`` merges those inside a task. Where
    that did not see them all, the caller folds in Spark.
    With ``symmetric`` both sides are the same set and each pair of tiles is
    visited once; the kernel sees ``diagonal`` when both tiles are the same.
    """
    lf, rf = left.slim(by), right.slim(by)
    left_cols = list(dict.fromkeys([*by, *left.columns]))
    right_cols = [] if per_left else [c for c in right.columns if c not in by]
    clash = set(left_cols) & set(right_cols)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    out = T.StructType(
        [lf.schema[c] for c in left_cols] + [rf.schema[c] for c in right_cols] + list(values)
    )
    arrow = to_arrow_schema(out)
    by = list(by)
    l_lead, lead = left.columns[0], right.columns[0]

    size, row_bytes = bytes_of(rf)
    if not symmetric and size <= broadcast_bytes:
        table = rf.toArrow().sort_by([(c, "ascending") for c in dict.fromkeys([*by, lead])])
        held = rf.sparkSession.sparkContext.broadcast(table)

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = held.value
            matrix = _unit_rows(whole)
            groups = _group_rows(whole, by)
            whole = whole.drop_columns([VECTOR])
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                for key, at in _group_rows(rows, by).items():
                    mates = groups.get(key, ())
                    for i in range(0, len(at) if len(mates) else 0, block_rows):
                        l_rows = rows.take(pa.array(at[i : i + block_rows]))
                        l_unit = _unit_rows(l_rows)
                        parts = []
                        for j in range(0, len(mates), block_rows):
                            pick = mates[j : j + block_rows]
                            sim = _cosines(l_unit, matrix[pick])
                            cell = Cell(l_rows, whole.take(pa.array(pick)), sim)
                            part = _emit(cell, kernel, left_cols, right_cols, arrow, None if fold is None else j)
                            if fold is None:
                                yield from part.to_batches()
                            else:
                                parts.append(part)
                        if parts:
                            yield from fold(pa.concat_tables(parts)).drop_columns([AT, MATE]).cast(arrow).to_batches()

        return Comparison(lf.mapInArrow(stream, out), fold is not None)

    l_bytes = row_bytes if symmetric else bytes_of(lf)[1]
    n_left = _tile_counts(lf, by, chunk_bytes, l_bytes, block_rows, SPREAD, "__lt_n")
    n_right = _tile_counts(rf, by, chunk_bytes, row_bytes, block_rows, SPREAD if symmetric else 1, "__rt_n")
    tiles_l = _tiles(lf, n_left, by, l_lead, "__lt_n", "__lt")
    tiles_r = _tiles(rf, n_right, by, lead, "__rt_n", "__rt")
    first_rt = F.col("__lt") if symmetric else F.lit(0)
    last_lt = F.col("__rt") if symmetric else F.col("__lt_n") - 1
    cells_l = _attach(tiles_l, n_right, by, "__rt_n").withColumn(
        "__rt", F.explode(F.sequence(first_rt, F.col("__rt_n") - 1))
    )
    cells_r = _attach(tiles_r, n_left, by, "__lt_n").withColumn(
        "__lt", F.explode(F.sequence(F.lit(0), last_lt))
    )
    keys = [*by, "__lt", "__rt"]
    # The sides of a cell come as rows of one table, so that what they make can leave the task block by block.
    l_names, r_names = ([c for c in f.columns if c not in by and c != VECTOR] for f in (lf, rf))
    l_as, r_as = ([f"__{side}{i}" for i in range(len(names))] for side, names in (("l", l_names), ("r", r_names)))

    def given(frame: DataFrame, names: Sequence[str], own: Sequence[str], other: Sequence[str], kinds: DataFrame, of: Sequence[str]) -> DataFrame:
        void = [F.lit(None).cast(kinds.schema[c].dataType).alias(a) for c, a in zip(of, other)]
        return frame.select(*keys, VECTOR, *[F.col(c).alias(a) for c, a in zip(names, own)], *void, F.lit(own is l_as).alias("__left"))

    def side_of(table: pa.Table, left_side: bool) -> pa.Table:
        mark = table["__left"]
        own, names = (l_as, l_names) if left_side else (r_as, r_names)
        return table.filter(mark if left_side else pc.invert(mark)).select([*keys, VECTOR, *own]).rename_columns([*keys, VECTOR, *names])

    def cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        l_rows, r_rows = side_of(table, True), side_of(table, False)
        del table
        if l_rows.num_rows == 0 or r_rows.num_rows == 0:
            return
        same = symmetric and l_rows["__lt"][0].as_py() == r_rows["__rt"][0].as_py()
        if same:
            l_rows = l_rows.sort_by(l_lead)
        r_rows = r_rows.sort_by(lead)
        l_unit, r_unit = _unit_rows(l_rows), _unit_rows(r_rows)
        l_rows, r_rows = l_rows.drop_columns([VECTOR]), r_rows.drop_columns([VECTOR])
        for i in range(0, l_rows.num_rows, block_rows):
            met = []
            for j in range(i if same else 0, r_rows.num_rows, block_rows):
                sim = _cosines(l_unit[i : i + block_rows], r_unit[j : j + block_rows])
                cell = Cell(l_rows.slice(i, block_rows), r_rows.slice(j, block_rows), sim, same and i == j)
                part = _emit(cell, kernel, left_cols, right_cols, arrow, None if fold is None else j)
                if fold is None:
                    yield from part.to_batches()
                else:
                    met.append(part)
            if met:
                yield from fold(pa.concat_tables(met)).drop_columns([AT, MATE]).cast(arrow).to_batches()

    cells = given(cells_l, l_names, l_as, r_as, rf, r_names).unionByName(given(cells_r, r_names, r_as, l_as, lf, l_names))
    return Comparison(cells.groupBy(*keys).applyInArrow(cell_rows, out), False)


def bytes_of(df: DataFrame) -> tuple[int, int]:
    """Bytes of a side and of its average row; texts count by their length."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    row = df.agg(
        F.count("*").alias("n"), F.max(F.size(VECTOR)).alias("dim"),
        *[F.sum(F.octet_length(c)).alias(f"__{i}") for i, c in enumerate(texts)],
    ).first()
    fixed = 8 * (row["dim"] or 0) + 64 * (len(df.columns) - 1)
    size = row["n"] * fixed + sum(row[f"__{i}"] or 0 for i in range(len(texts)))
    return size, size // max(1, row["n"])


def _tile_counts(
    df: DataFrame, by: Sequence[str], chunk_bytes: int, row_bytes: int, block_rows: int, spread: int, name: str
) -> DataFrame | int:
    """Tiles of each group: a frame, or a number when there are no groups."""
    rows = max(block_rows, chunk_bytes // max(1, row_bytes))
    tiles = F.greatest(F.ceil(F.count("*") / rows), F.least(F.lit(spread), F.ceil(F.count("*") / block_rows)))
    counts = df.groupBy(*by).agg(tiles.cast("int").alias(name))
    return counts if by else counts.first()[0]


def _attach(df: DataFrame, counts: DataFrame | int, by: Sequence[str], name: str) -> DataFrame:
    if isinstance(counts, DataFrame):
        return df.join(counts, list(by))
    return df.where(F.lit(counts > 0)).withColumn(name, F.lit(counts).cast("int"))


def _tiles(
    df: DataFrame, counts: DataFrame | int, by: Sequence[str], key: str, n: str, name: str
) -> DataFrame:
    """Tile number by hash of the row's key, so a tile holds about ``block_rows`` rows."""
    tile = F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    return _attach(df, counts, by, n).withColumn(name, tile).drop(n)


# --- kernels -----------------------------------------------------------------


def _best(cell: Cell):
    at = np.arange(cell.sim.shape[0])
    pick = cell.sim.argmax(axis=1)
    return at, pick, {"sim": cell.sim[at, pick], "rank": np.ones(len(at), np.int32)}


def _best_k(k: int) -> Kernel:
    def kernel(cell: Cell):
        n, m = cell.sim.shape
        if m > k:
            bound = np.partition(cell.sim, m - k, axis=1)[:, m - k]
            li, ri = np.nonzero(cell.sim >= bound[:, None])
        else:
            li, ri = np.indices((n, m)).reshape(2, -1)
        sims = cell.sim[li, ri]
        rank = np.lexsort((ri, -sims, li))
        li, ri, sims = li[rank], ri[rank], sims[rank]
        place = np.arange(len(li)) - np.searchsorted(li, li, side="left")
        keep = place < k
        return li[keep], ri[keep], {"sim": sims[keep], "rank": (place[keep] + 1).astype(np.int32)}

    return kernel


def _all(cell: Cell):
    n, m = cell.sim.shape
    return np.repeat(np.arange(n), m), np.tile(np.arange(m), n), {"sim": cell.sim.ravel()}


SIM = T.StructType([T.StructField("sim", T.DoubleType())])
RANKED = T.StructType([*SIM, T.StructField("rank", T.IntegerType())])


# --- operators ---------------------------------------------------------------


def nearest(left: Side, right: Side, *, by: Sequence[str] = (), **layout) -> DataFrame:
    """Best right row of every left row; ties go to the lowest right id.

    Left rows that meet no right row are absent.
    """
    return top_k(left, right, 1, by=by, **layout).drop("rank")


def top_k(left: Side, right: Side, k: int, *, by: Sequence[str] = (), **layout) -> DataFrame:
    """The ``k`` best right rows of every left row with their rank from 1."""
    keys = list(dict.fromkeys([*by, *left.columns]))
    mate = right.columns[0]

    def fold(table: pa.Table) -> pa.Table:
        at, sim, other = (table[c].to_numpy() for c in (AT, "sim", MATE))
        order = np.lexsort((other, -sim, at))
        own = at[order]
        place = np.arange(len(own)) - np.searchsorted(own, own, side="left")
        keep = place < k
        ranked = table.take(pa.array(order[keep]))
        return ranked.set_column(table.schema.get_field_index("rank"), "rank", pa.array(place[keep] + 1))

    hits = compare(
        left, right, _best if k == 1 else _best_k(k), RANKED, by=by, fold=fold, **layout
    )
    if hits.whole:
        return hits.rows
    rest = [c for c in hits.rows.columns if c not in keys and c != "rank"]
    if k == 1:
        best = F.min_by(
            F.struct(*rest),
            F.struct((-F.col("sim")).alias("s"), F.col(mate).alias("i")),
        )
        top = hits.rows.groupBy(*keys).agg(best.alias("__b"))
        return top.select(*keys, "__b.*", F.lit(1).alias("rank"))
    w = Window.partitionBy(*keys).orderBy(F.desc("sim"), F.col(mate))
    return hits.rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def full_matrix(left: Side, right: Side, *, by: Sequence[str] = (), **layout) -> DataFrame:
    """Every left row with every right row: the stored cluster-by-article table."""
    return compare(left, right, _all, SIM, by=by, **layout).rows


def pairs_above(
    frame: DataFrame, key: str, vector: str, bound: float, *, by: Sequence[str] = (), **layout
) -> DataFrame:
    """Pairs ``(a, b, sim)`` with ``a < b`` and a cosine above ``bound`` inside one set."""
    slim = frame.select(*by, F.col(key), F.col(vector))
    one = Side(slim.withColumnRenamed(key, "a"), vector, ["a"])
    two = Side(slim.withColumnRenamed(key, "b"), vector, ["b"])

    def kernel(cell: Cell):
        hit = cell.sim > bound
        if cell.diagonal:
            hit = np.triu(hit, 1)
        li, ri = np.nonzero(hit)
        return li, ri, {"sim": cell.sim[li, ri]}

    found = compare(one, two, kernel, SIM, by=by, symmetric=True, **layout).rows
    return found.select(
        *by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim"
    )


def novelty(
    articles: Side,
    existing: Side,
    flag: str,
    *,
    by: Sequence[str] = (),
    critical: float = Thresholds.novelty_critical,
    other: float = Thresholds.novelty_other,
    title: str = "kb_title",
    **layout,
) -> DataFrame:
    """Closest existing article of every draft, and whether the draft is new enough.

    With nothing to compare to, a draft is new: similarity 0 and an empty title.
    """
    keys = list(dict.fromkeys([*by, *articles.columns]))
    best = nearest(articles, existing, by=by, **layout)
    base = articles.frame.where(F.col(articles.vector).isNotNull()).select(*keys)
    lead = list(dict.fromkeys([*by, articles.columns[0]]))
    seen = base.join(best.select(*lead, "sim", title), lead, "left")
    bound = F.when(F.col(flag) == "CRITICAL", critical).otherwise(other)
    sim = F.coalesce("sim", F.lit(0.0))
    return seen.select(
        *keys,
        sim.alias("max_existing_kb_sim"),
        F.coalesce(title, F.lit("")).alias("closest_existing_kb"),
        (F.col("sim").isNull() | (sim < bound)).alias("novelty_pass"),
    )


def alignment(
    articles: DataFrame,
    centroids: DataFrame,
    on: Sequence[str],
    vector: str,
    centroid: str,
    bound: float = Thresholds.alignment,
) -> DataFrame:
    """Cosine of each article and the centroid of its own cluster: a plain equi-join."""
    joined = articles.join(centroids.select(*on, centroid), list(on), "left")
    cosine = F.round(dot(normalise(F.col(vector)), normalise(F.col(centroid))), SIM_DIGITS)
    score = F.coalesce(cosine, F.lit(0.0))
    return joined.withColumn("alignment_score", score).withColumn(
        "alignment_pass", F.col(centroid).isNotNull() & (score >= bound)
    )


def classify(
    hits: DataFrame,
    covered: float = Thresholds.covered,
    partial: float = Thresholds.partial,
    below: str = "UNCOVERED",
    name: str = "coverage",
) -> DataFrame:
    return hits.withColumn(name, gap_class(F.col("sim"), covered, partial, below))
