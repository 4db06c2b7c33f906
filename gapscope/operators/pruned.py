"""Pairs above a threshold without comparing what cannot reach it.

Rows go to the cell of their nearest pivot (hashed rows of their group, one per ``cell_rows`` rows);
a crowded cell is dealt into parts, so a hot group is many cells. A cell is known by its pivot and
its radius, the widest angle between them. Two rows lie no nearer than the angle of their pivots
less both radii, so only pairs of cells whose bound reaches the threshold are multiplied. The table
of bounds has a row per cell; it is compared before any vector moves. Cells are dealt into tiles,
as large as a task may hold; a vector is sent once per tile that holds a near cell, not once per
near cell. The result is that of ``similarity.pairs_above``, row for row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gapscope.config import SEED, SIM_DIGITS
from gapscope.functions.vectors import dot, normalise
from gapscope.operators.minibatch import matrix
from gapscope.operators.rounds import cut, drop_table
from gapscope.operators.similarity import SIM, SPREAD, Cell, Side, compare, nearest, pairs_above

CELL_ROWS = 1024
#: Rows of a tile.
TILE_ROWS = 1 << 15
#: Cosines are rounded; near 1 their angle may be off by this much.
ROUNDED = 1e-4


def in_cells(frame: DataFrame, key: str, vector: str, by: Sequence[str] = (), cell_rows: int = CELL_ROWS, **layout) -> tuple[DataFrame, DataFrame]:
    """Rows (by, key, unit, cell) and bounds (by, cell, centre, radius). Zero vectors are near nothing and stay out."""
    by = list(by)
    unit = normalise(F.col(vector).cast("array<double>"))
    rows = cut(frame.where(F.col(vector).isNotNull()).select(*by, F.col(key).alias("key"), unit.alias("unit")).where(dot(F.col("unit"), F.col("unit")) > 0.5))
    chance = F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1 << 30))
    drawn = rows.where(chance < (1 << 30) // cell_rows).select(*by, "key")
    first = rows.groupBy(*by).agg(F.min_by("key", F.struct(chance, "key")).alias("key")).select(*by, "key").where("key is not null")
    pivots = cut(rows.join(drawn.unionByName(first).distinct(), [*by, "key"]).select(*by, F.col("key").alias("pivot"), F.col("unit").alias("centre")))
    placed = cut(nearest(Side(rows, "unit", ["key", "unit"]), Side(pivots, "centre", ["pivot"]), by=by, **layout))
    parts = placed.groupBy(*by, "pivot").agg(F.ceil(F.count("*") / (4 * cell_rows)).alias("parts"))
    part = F.pmod(F.xxhash64("key", F.lit(SEED + 1)), F.col("parts"))
    dealt = cut(placed.join(parts, [*by, "pivot"]).select(*by, "key", "unit", "pivot", "sim", F.concat_ws("#", F.col("pivot").cast("string"), part.cast("string")).alias("cell")))
    widest = dealt.groupBy(*by, "pivot", "cell").agg(F.min("sim").alias("least"))
    bounds = cut(widest.join(pivots, [*by, "pivot"]).select(*by, "cell", "centre", F.acos(F.least(F.greatest("least", F.lit(-1.0)), F.lit(1.0))).alias("radius")))
    drop_table(rows.sparkSession, rows, placed, pivots)
    return dealt.drop("pivot", "sim"), bounds


def near_cells(bounds: DataFrame, bound: float, by: Sequence[str] = (), **layout) -> DataFrame:
    """(by, a_cell, b_cell): pairs of cells, each with itself too, that may hold a pair above ``bound``."""
    limit = float(np.arccos(bound)) + ROUNDED
    one = bounds.select(*by, F.col("cell").alias("a_cell"), F.col("radius").alias("a_radius"), "centre")
    two = bounds.select(*by, F.col("cell").alias("b_cell"), F.col("radius").alias("b_radius"), "centre")

    def kernel(cell: Cell):
        apart = np.arccos(np.clip(cell.sim, -1.0, 1.0))
        near = apart - cell.left_values("a_radius")[:, None] - cell.right_values("b_radius") <= limit
        if cell.diagonal:
            np.fill_diagonal(near, True)
            near = np.triu(near)
        li, ri = np.nonzero(near)
        return li, ri, {"sim": cell.sim[li, ri]}

    found = compare(Side(one, "centre", ["a_cell", "a_radius"]), Side(two, "centre", ["b_cell", "b_radius"]), kernel, SIM, by=list(by), symmetric=True, **layout)
    return found.rows.select(*by, "a_cell", "b_cell")


def pruned_pairs_above(frame: DataFrame, key: str, vector: str, bound: float, *, by: Sequence[str] = (), cell_rows: int = CELL_ROWS, **layout) -> DataFrame:
    """Pairs (by, a, b, sim) with ``a < b`` and a cosine above ``bound`` inside a group; keys are unique in it.

    Below a bound of 0 zero vectors have partners too and hardly any cells could be skipped: all pairs are compared.
    """
    by = list(by)
    if bound < 0:
        return pairs_above(frame, key, vector, bound, by=by, **layout)
    rows, bounds = in_cells(frame, key, vector, by, cell_rows, **layout)
    near = near_cells(bounds, bound, by, **layout)
    kind = rows.schema["key"].dataType
    out = T.StructType([*(rows.schema[c] for c in by), T.StructField("a", kind), T.StructField("b", kind), *SIM])
    arrow = to_arrow_schema(out)
    keys = [*by, "__one", "__two"]
    # Cells are dealt into tiles by hash; each pair of cells is the work of the pair of their tiles.
    tiles = rows.groupBy(*by).agg(F.greatest(F.ceil(F.count("*") / TILE_ROWS), F.least(F.lit(SPREAD), F.ceil(F.count("*") / (4 * cell_rows)))).alias("__tiles"))
    tile = lambda c: F.pmod(F.xxhash64(c), F.col("__tiles"))
    same = [near[c].eqNullSafe(tiles[c]) for c in by]
    placed = (near.join(tiles, same) if by else near.crossJoin(tiles)).select(*[near[c] for c in by], "a_cell", "b_cell", tile("a_cell").alias("__one"), tile("b_cell").alias("__two"))
    turn = F.col("__one") > F.col("__two")
    ends = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    placed = cut(placed.select(*by, F.least("__one", "__two").alias("__one"), F.greatest("__one", "__two").alias("__two"), ends("a_cell", "b_cell").alias("a_cell"), ends("b_cell", "a_cell").alias("b_cell")))

    def sent(side: str) -> DataFrame:
        """Rows of the cells of one side, once per pair of tiles they are needed in."""
        needed = placed.select(*keys, F.col(side).alias("cell")).distinct()
        met = rows.join(needed, [rows["cell"] == needed["cell"], *(rows[c].eqNullSafe(needed[c]) for c in by)])
        return met.select(*[rows[c].alias(c) for c in by], *[needed[c].alias(c) for c in ("__one", "__two")], rows["cell"].alias("cell"), rows["key"].alias("key"), rows["unit"].alias("unit"))

    # The cells that a cell meets are a row among its vectors.
    mates = placed.groupBy(*keys, F.col("a_cell").alias("cell")).agg(F.collect_list("b_cell").alias("mates"))
    none = F.lit(None)
    left = sent("a_cell").withColumn("mates", none.cast("array<string>")).unionByName(
        mates.withColumn("key", none.cast(kind)).withColumn("unit", none.cast("array<double>"))
    )

    def multiply(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return arrow.empty_table()
        listed = one.filter(pc.is_valid(one["mates"]))
        one, two = one.filter(pc.is_valid(one["unit"])).sort_by("cell"), two.sort_by("cell")
        ranges = [cell_ranges(t["cell"].to_pylist()) for t in (one, two)]
        units = [matrix(t["unit"]) for t in (one, two)]
        ids = [t["key"].to_numpy(zero_copy_only=False) for t in (one, two)]
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for cell, mates in zip(listed["cell"].to_pylist(), listed["mates"].to_pylist()):
            low, high = ranges[0][cell]
            for mate in mates:
                first, last = ranges[1][mate]
                sim = np.round(units[0][low:high] @ units[1][first:last].T, SIM_DIGITS) + 0.0
                li, ri = np.nonzero(sim > bound)
                if cell == mate:
                    less = ids[0][li + low] < ids[1][ri + first]
                    li, ri = li[less], ri[less]
                parts.append((li + low, ri + first, sim[li, ri]))
        li, ri, sims = (np.concatenate(x) for x in zip(*parts))
        less = ids[0][li] < ids[1][ri]
        a, b = one["key"].take(pa.array(li)), two["key"].take(pa.array(ri))
        at = pa.array(np.zeros(len(li), np.int64))
        columns = [one[c].slice(0, 1).take(at) for c in by]
        columns += [pc.if_else(pa.array(less), a, b), pc.if_else(pa.array(less), b, a), pa.chunked_array([pa.array(sims)])]
        return pa.table([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return left.groupBy(*keys).cogroup(sent("b_cell").groupBy(*keys)).applyInArrow(multiply, out)


def cell_ranges(cells: list[str]) -> dict[str, tuple[int, int]]:
    """First and past the last place of every cell in a sorted list."""
    starts = [i for i, c in enumerate(cells) if not i or c != cells[i - 1]]
    return {cells[i]: (i, j) for i, j in zip(starts, [*starts[1:], len(cells)])}
