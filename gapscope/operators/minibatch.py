"""Mini-batch k-means: many models (values of K and starts) fitted side by side, a batch a round.

Rows are dealt to batches by hash, and the table is written once in that order, so a round reads
one batch. In a round every task multiplies its rows with the centres of all models that still
run and returns sums per centre; no row leaves its task, and what reaches the driver is bounded by
the size of the centres, which is checked. A centre then moves towards the mean of its rows of the
batch by their share in all rows it has seen, so steps fall as it settles. Centres that have seen
hardly any rows are starved and go to rows of the batch. A model stops by itself when its smoothed
cost per row no longer falls. Start centres are drawn from a bounded sample, far from each other.

Costs, sizes and silhouettes of all models come from two passes over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscope.config import SEED, Thresholds
from gapscope.operators.rounds import cut, cut_by, drop_table

CENTRE_BYTES = 512 << 20
BATCH_ROWS, MOST_BATCHES = 4096, 256
#: A centre is starved below this share of what the best fed centre has seen.
STARVED = 0.01
#: Rounds without a fall of the smoothed cost by this share end a fit.
PATIENCE, LEAST_FALL = 10, 1e-3
#: Entries of a block of distances in a task.
BLOCK = 1 << 22
FILE_ROWS = 1 << 17
SUMS = "centre int, n long, cost double, square double, total array<double>"


@dataclass
class Model:
    k: int
    start: int
    centres: np.ndarray
    seen: np.ndarray = field(init=False)
    smooth: float | None = None
    best: float = np.inf
    idle: int = 0
    rounds: int = 0
    live: bool = True
    unfed: int = 0

    def __post_init__(self):
        self.seen = np.zeros(len(self.centres))

    def move(self, n: np.ndarray, total: np.ndarray) -> None:
        """Take in the rows of a batch: their number and sum by centre."""
        self.seen += n
        fed = n > 0
        self.centres[fed] += (total[fed] - n[fed, None] * self.centres[fed]) / self.seen[fed, None]

    def starving(self, rows: int) -> np.ndarray:
        """Centres to replace after a batch; looked for when some have seen nothing, or ten rows per centre have passed."""
        self.unfed += rows
        if (self.seen > 0).all() and self.unfed < 10 * self.k:
            return np.empty(0, int)
        self.unfed = 0
        poor = np.flatnonzero(self.seen < STARVED * self.seen.max())
        return poor[np.argsort(self.seen[poor], kind="stable")][: rows // 2]

    def replace(self, poor: np.ndarray, rows: np.ndarray) -> None:
        rest = np.delete(self.seen, poor)
        self.centres[poor], self.seen[poor] = rows, rest.min() if len(rest) else 0

    def judge(self, cost: float, rows: int, total: int) -> None:
        """Smooth the cost per row of a batch of ``rows``; stop after too many rounds without a fall."""
        self.rounds += 1
        weight = min(1.0, 2.0 * rows / (total + 1))
        self.smooth = cost / rows if self.smooth is None else self.smooth * (1 - weight) + cost / rows * weight
        if self.smooth < self.best * (1 - LEAST_FALL):
            self.best, self.idle = self.smooth, 0
        else:
            self.idle += 1
            self.live = self.idle < PATIENCE


@dataclass
class Fit:
    """The best model of a K with its cost over all rows and the rows of each centre."""

    k: int
    centres: np.ndarray
    inertia: float
    sizes: np.ndarray
    silhouette: float | None = None


def far_apart(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` rows of the sample: each the best of a few that are drawn by squared distance to those before it."""
    length, trials = (sample * sample).sum(axis=1), 2 + int(np.log(k))
    apart = lambda at: np.maximum(0.0, length[None, :] - 2 * sample[at] @ sample.T + length[at][:, None])
    picked = [int(rng.integers(len(sample)))]
    near = apart(picked)[0]
    while len(picked) < k:
        reach = np.cumsum(near)
        drawn = np.minimum(np.searchsorted(reach, rng.random(trials) * reach[-1], side="right"), len(sample) - 1)
        nearer = np.minimum(near, apart(drawn))
        best = int(nearer.sum(axis=1).argmin())
        picked.append(int(drawn[best]))
        near = nearer[best]
    return sample[picked].copy()


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        rows = matrix(batch.column("vec"))
        size = max(1, BLOCK // max(1, width))
        yield from (rows[i : i + size] for i in range(0, len(rows), size))


def _ranges(models: Sequence[np.ndarray]) -> list[tuple[int, int]]:
    ends = np.cumsum([len(m) for m in models])
    return [(int(e) - len(m), int(e)) for e, m in zip(ends, models)]


def sums(rows: DataFrame, models: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, cost, sum of squares and sum of vectors of every centre of all models, numbered through."""
    ranges, width = _ranges(models), sum(map(len, models))
    held = rows.sparkSession.sparkContext.broadcast(np.concatenate(models))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = held.value
        length = (centres * centres).sum(axis=1)
        n, cost, square, total = np.zeros(width, np.int64), np.zeros(width), np.zeros(width), np.zeros(centres.shape)
        for block in _blocks(batches, width):
            own = (block * block).sum(axis=1)
            apart = length - 2 * block @ centres.T
            for low, high in ranges:
                pick = apart[:, low:high].argmin(axis=1)
                order = np.argsort(pick, kind="stable")
                first = np.flatnonzero(np.diff(pick[order], prepend=-1))
                at = pick[order[first]] + low
                n[at] += np.diff(np.append(first, len(order)))
                cost[at] += np.add.reduceat(np.maximum(0.0, own + apart[np.arange(len(block)), low + pick])[order], first)
                square[at] += np.add.reduceat(own[order], first)
                total[at] += np.add.reduceat(block[order], first)
        at = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(np.arange(0, len(at) * total.shape[1] + 1, max(1, total.shape[1]), dtype=np.int32)[: len(at) + 1], total[at].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(cost[at]), pa.array(square[at]), lists], ["centre", "n", "cost", "square", "total"])

    found = rows.select("vec").mapInArrow(add, SUMS).groupBy("centre").agg(
        F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.sum("square").alias("square"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total")
    ).toArrow()
    at = found["centre"].to_numpy()
    out = [np.zeros(width) for _ in range(3)] + [np.zeros(held.value.shape)]
    for into, name in zip(out, ("n", "cost", "square")):
        into[at] = found[name].to_numpy()
    if len(at):
        out[3][at] = matrix(found["total"])
    held.unpersist()
    return tuple(out)


def silhouettes(rows: DataFrame, fits: Sequence[Fit], square: Sequence[np.ndarray], total: Sequence[np.ndarray]) -> list[float]:
    """Mean silhouette of squared distances for every fit, from the clusters' sums; one pass for all."""
    # Empty clusters have no place among the others.
    held = rows.sparkSession.sparkContext.broadcast([(f.centres, f.sizes, s, t) for f, s, t in zip(fits, square, total)])
    width = sum(len(f.centres) for f in fits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        score, n = np.zeros(len(known)), 0
        for block in _blocks(batches, width):
            n += len(block)
            own, at = (block * block).sum(axis=1)[:, None], np.arange(len(block))
            for i, (centres, size, squares, totals) in enumerate(known):
                pick = ((centres * centres).sum(axis=1) - 2 * block @ centres.T).argmin(axis=1)
                some = np.maximum(size, 1)
                mean = np.maximum(0.0, own + squares / some - 2 * block @ (totals / some[:, None]).T)
                inner = mean[at, pick] * size[pick] / np.maximum(size[pick] - 1, 1)
                mean[:, size == 0] = np.inf
                mean[at, pick] = np.inf
                outer = mean.min(axis=1)
                most = np.maximum(inner, outer)
                good = (size[pick] > 1) & np.isfinite(outer) & (most > 0)
                score[i] += ((outer - inner)[good] / most[good]).sum()
        yield pa.RecordBatch.from_pydict({"fit": np.arange(len(known), dtype=np.int32), "score": score, "n": np.full(len(known), n)})

    found = rows.select("vec").mapInArrow(add, "fit int, score double, n long").groupBy("fit").agg((F.sum("score") / F.sum("n")).alias("s")).toPandas()
    held.unpersist()
    by = dict(zip(found["fit"], found["s"]))
    return [float(by.get(i, -1.0)) if (f.sizes > 0).sum() > 1 else -1.0 for i, f in enumerate(fits)]


@dataclass
class Dealt:
    """The rows of a table with their batch, written once."""

    rows: DataFrame
    total: int
    batches: int
    width: int

    def batch(self, k: int) -> DataFrame:
        return self.rows.where(F.col("__batch") == k % self.batches)

    def first_rows(self, table: DataFrame, n: int, turn: int) -> np.ndarray:
        """``n`` rows in the order of a hash of their key and ``turn``; ``n`` bounds what the driver gets."""
        picked = table.orderBy(F.xxhash64("__key", F.lit(turn)), "__key").limit(n).select("vec")
        return matrix(picked.toArrow()["vec"])


def deal(df: DataFrame, key: str, vector: str, batch_rows: int = BATCH_ROWS, seed: int = SEED) -> Dealt:
    """Batches by hash of the key: as many as ``batch_rows`` asks for, ``MOST_BATCHES`` at most."""
    slim = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("__key"), F.col(vector).cast("array<double>").alias("vec"))
    seen = slim.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    total, width = seen["n"], seen["width"] or 0
    batches = min(MOST_BATCHES, max(1, -(-total // batch_rows)))
    files = max(1, -(-total // (batches * FILE_ROWS)))
    named = slim.withColumn("__batch", F.pmod(F.xxhash64("__key", F.lit(seed)), F.lit(batches)).cast("int")).withColumn("__file", F.pmod(F.xxhash64("__key"), F.lit(files)).cast("int"))
    dealt = named.repartition(F.col("__batch"), F.col("__file")).drop("__file") if batches * files > 1 else named.drop("__file")
    return Dealt(cut_by(dealt, "__batch"), total, batches, width)


def fit_models(dealt: Dealt, asked: Sequence[tuple[int, int]], *, epochs: int = 300, sample_rows: int = 3 * BATCH_ROWS, seed: int = SEED) -> list[Model]:
    """Models of all (K, start) ``asked``, each fitted until it stands still, ``epochs`` readings of the table at most."""
    need = sum(k for k, _ in asked) * dealt.width * 8
    if need > CENTRE_BYTES:
        raise ValueError(f"the centres of {len(asked)} models take {need} bytes; ask for fewer at a time")
    sample = dealt.first_rows(dealt.rows, max(sample_rows, 3 * max(k for k, _ in asked)), seed + 1)
    models = [Model(k, start, far_apart(sample, min(k, len(sample)), np.random.default_rng([seed, k, start]))) for k, start in asked]
    for turn in range(epochs * dealt.batches):
        live = [m for m in models if m.live]
        if not live:
            break
        batch = dealt.batch(turn)
        n, cost, _, total = sums(batch, [m.centres for m in live])
        rows = int(n[: len(live[0].centres)].sum())
        if not rows:
            continue
        poor = []
        for model, (low, high) in zip(live, _ranges([m.centres for m in live])):
            model.move(n[low:high], total[low:high])
            poor.append(model.starving(rows))
            model.judge(cost[low:high].sum(), rows, dealt.total)
        most = max(map(len, poor))
        fresh = dealt.first_rows(batch, most, turn) if most else None
        for model, at in zip(live, poor):
            if len(at):
                model.replace(at, fresh[: len(at)])
    return models


def best_fits(dealt: Dealt, models: Sequence[Model], with_silhouette: bool = False) -> list[Fit]:
    """Per K the model of least cost over all rows (the earlier start, if costs are equal to nine digits)."""
    n, cost, square, total = sums(dealt.rows, [m.centres for m in models])
    best: dict[int, tuple[Fit, int, int]] = {}
    for model, (low, high) in zip(models, _ranges([m.centres for m in models])):
        fit = Fit(model.k, model.centres, float(cost[low:high].sum()), n[low:high])
        if model.k not in best or fit.inertia < best[model.k][0].inertia * (1 - 1e-9):
            best[model.k] = fit, low, high
    fits = [f for f, _, _ in best.values()]
    if with_silhouette and fits:
        parts = [(square[low:high], total[low:high]) for _, low, high in best.values()]
        for fit, value in zip(fits, silhouettes(dealt.rows, fits, *zip(*parts))):
            fit.silhouette = value
    return fits


def in_order(centres: np.ndarray) -> np.ndarray:
    rounded = [tuple(np.round(c, 6)) for c in centres]
    return centres[sorted(range(len(centres)), key=rounded.__getitem__)]


def nearest_centre(centres: np.ndarray) -> Callable:
    """A column function: the number of a vector's nearest centre, in the order of the centres; null of a null vector."""
    ordered = in_order(centres)
    length = (ordered * ordered).sum(axis=1)

    @F.pandas_udf("int")
    def place(vectors: pd.Series) -> pd.Series:
        known = vectors.notna().to_numpy()
        out = pd.array(np.zeros(len(vectors), np.int32), "Int32")
        if known.any():
            rows = np.stack(vectors[known].to_list())
            out[known] = (length - 2 * rows @ ordered.T).argmin(axis=1).astype(np.int32)
        out[~known] = pd.NA
        return pd.Series(out)

    return place


def kmeans(df: DataFrame, key: str, vector: str, k: int, *, tries: int = 15, epochs: int = 500, batch_rows: int = BATCH_ROWS, seed: int = SEED) -> DataFrame:
    """``df`` with a ``cluster_id`` per row, by the best of ``tries`` starts; ids follow the order of the centres.

    The rows are stored once, so that a computed vector is not computed again beside the Python function that places it.
    """
    df = cut(df)
    dealt = deal(df, key, vector, batch_rows, seed)
    if not dealt.total:
        return df.withColumn("cluster_id", F.lit(None).cast("int"))
    models = fit_models(dealt, [(min(k, dealt.total), start) for start in range(tries)], epochs=epochs, sample_rows=3 * batch_rows, seed=seed)
    fit = best_fits(dealt, models)[0]
    drop_table(df.sparkSession, dealt.rows)
    return df.withColumn("cluster_id", nearest_centre(fit.centres)(F.col(vector).cast("array<double>")))


def sweep(
    df: DataFrame, key: str, vector: str, k_values: Sequence[int] = Thresholds.k_values, *,
    tries: int = 5, epochs: int = 300, batch_rows: int = BATCH_ROWS, seed: int = SEED,
) -> DataFrame:
    """Inertia, silhouette and largest share of every K, all fitted side by side; K at or above the row count is void."""
    dealt = deal(df, key, vector, batch_rows, seed)
    asked = [(k, start) for k in k_values if k < dealt.total for start in range(tries)]
    fits = {}
    if asked:
        models = fit_models(dealt, asked, epochs=epochs, sample_rows=3 * batch_rows, seed=seed)
        fits = {f.k: f for f in best_fits(dealt, models, True)}
    drop_table(df.sparkSession, dealt.rows)
    rows = [
        (k, fits[k].inertia, fits[k].silhouette, float(fits[k].sizes.max() / dealt.total)) if k in fits else (k, float("inf"), -1.0, 1.0) for k in k_values
    ]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, max_share double")
