"""Principal axes of a table of vectors: merged sums of squares, then power iteration with deflation.

Only sums leave the tasks, and a task has at least as many rows as a vector has numbers, so its
sums are never larger than what it read. Axes do not depend on how rows are split (but for the
last digits of the sums), and their sign is fixed: the largest component is positive, the first
of equal ones. Rows without a vector take no part and get null coordinates. Where the rows spread
in fewer directions than axes are asked for, the others are zero, with variance zero.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscope.functions.vectors import as_doubles, dot
from gapscope.operators.minibatch import matrix

#: The driver holds one square matrix of this size at most (8192 numbers a vector).
SQUARE_BYTES = 512 << 20
#: Powers are squared, so this many are two to the sixtieth steps; equal variances end it sooner.
SQUARINGS = 60
#: A share of the whole variance below which there is no direction left.
NO_SPREAD = 1e-13
SUMS = "at int, n long, total array<double>"


class Axes(NamedTuple):
    mean: np.ndarray
    axes: np.ndarray  # a row per axis, by falling variance
    variances: np.ndarray
    whole: float  # variance in all directions


def covariance(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (over n) of the vectors; empty ones without vectors."""
    rows = df.select(as_doubles(F.col(vector)).alias("vec")).where(F.col("vec").isNotNull())
    first = rows.first()
    if first is None:
        return np.zeros(0), np.zeros((0, 0))
    # Sums of differences to a row among them lose no digits where all lie close together.
    shift = np.array(first["vec"])
    width = len(shift)
    if width * width * 8 > SQUARE_BYTES:
        raise ValueError(f"vectors of {width} numbers are too long for a matrix on the driver")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            block = matrix(batch.column("vec"))
            if len(block):
                block = block - shift
                n, total, square = n + len(block), total + block.sum(axis=0), square + block.T @ block
        if n:
            lists = pa.ListArray.from_arrays(np.arange(0, (width + 1) * width + 1, width, dtype=np.int32), np.vstack([square, total]).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array([n] * (width + 1)), lists], ["at", "n", "total"])

    tasks = max(1, rows.count() // width)
    found = rows.coalesce(tasks).mapInArrow(add, SUMS).groupBy("at").agg(
        F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total")
    ).orderBy("at").toArrow()
    means = matrix(found["total"]) / found["n"][0].as_py()
    return shift + means[width], means[:width] - np.outer(means[width], means[width])


def strongest(square: np.ndarray) -> np.ndarray:
    """The direction of the largest variance, by squaring powers until they stand still."""
    power = square / np.trace(square)
    for _ in range(SQUARINGS):
        grown = power @ power
        grown /= np.trace(grown)
        still = np.abs(grown - power).max() < 1e-15
        power = grown
        if still:
            break
    axis = power[np.diag(power).argmax()]
    axis = axis / np.linalg.norm(axis)
    return axis * np.sign(axis[np.abs(axis).round(9).argmax()])


def principal_axes(df: DataFrame, vector: str, n: int = 2) -> Axes:
    mean, left = covariance(df, vector)
    whole = float(np.trace(left))
    axes, variances = np.zeros((n, len(mean))), np.zeros(n)
    for i in range(n):
        if np.trace(left) <= NO_SPREAD * whole or not whole > 0:
            break
        axes[i] = strongest(left)
        variances[i] = axes[i] @ left @ axes[i]
        left = left - variances[i] * np.outer(axes[i], axes[i])
    return Axes(mean, axes, variances, whole)


def project(df: DataFrame, vector: str, found: Axes, names: Sequence[str]) -> DataFrame:
    """``df`` with a column per axis: how far the row lies from the mean along it."""
    along = [dot(as_doubles(F.col(vector)), F.lit(a)) - float(found.mean @ a) for a in found.axes]
    return df.withColumns(dict(zip(names, along)))
