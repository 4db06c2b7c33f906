"""Exact percentile of similarities, per group, without gathering a group in one task.

Similarities are whole numbers of 10^-9 between -1 and 1. The rank looked for is
narrowed down digit group by digit group: each pass counts rows per bucket (with
map-side counting), and only rows of the bucket holding the rank go on. The rows
are read once per pass, so they should be a stored table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapscope.config import SIM_DIGITS
from gapscope.operators.rounds import cut, drop_table
from gapscope.operators.similarity import Cell, Side, compare

SCALE = 10**SIM_DIGITS
SHIFTS = (22, 11, 0)
STRETCH = 17
KEYED = T.StructType([T.StructField("__key", T.LongType()), T.StructField("__c", T.LongType())])


def similarity_percentile(
    df: DataFrame, value: str, q: float, by: Sequence[str] = (), name: str = "percentile"
) -> DataFrame:
    """One row per ``by`` group: the ``q`` quantile with linear interpolation."""
    by = list(by)
    key = (F.round(F.col(value) * SCALE).cast("long") + SCALE).alias("__key")
    keyed = df.where(F.col(value).isNotNull()).select(*by, key)
    position = (F.col("__n") - 1) * q
    targets = (
        keyed.groupBy(*by)
        .agg(F.count("*").alias("__n"))
        .select(
            *by,
            (position - F.floor(position)).alias("__part"),
            F.explode(F.array(F.floor(position), F.ceil(position))).alias("__goal"),
        )
        .distinct()
        .withColumn("__rank", F.col("__goal"))
        .withColumn("__prefix", F.lit(0).cast("long"))
    )
    w = Window.partitionBy(*by, "__goal").orderBy("__next")
    for above, shift in zip((62, *SHIFTS), SHIFTS):
        inside = keyed.withColumn("__prefix", F.shiftright("__key", above)).join(targets, [*by, "__prefix"])
        counts = inside.groupBy(
            *by, "__part", "__goal", "__rank", F.shiftright("__key", shift).alias("__next")
        ).agg(F.count("*").alias("__c"))
        before = F.col("__upto") - F.col("__c")
        targets = (
            counts.withColumn("__upto", F.sum("__c").over(w))
            .where((F.col("__rank") >= before) & (F.col("__rank") < F.col("__upto")))
            .select(*by, "__part", "__goal", (F.col("__rank") - before).alias("__rank"), F.col("__next").alias("__prefix"))
        )
    found = (F.col("__prefix") - SCALE) / SCALE
    low, high = F.min(found), F.max(found)
    return targets.groupBy(*by).agg((low + F.max("__part") * (high - low)).alias(name))


def pairs_above_percentile(left: Side, right: Side, group: str, q: float, **layout) -> DataFrame:
    """Per ``group`` of left rows: pairs with right rows (``pairs``) and those above the ``q`` quantile of all pairs (``above``).

    Pairs never become rows. A first pass counts them per stretch of ``1 << STRETCH`` similarities; a
    second counts per group those above the stretch of the quantile and lists, by value, those inside it.
    What comes to the driver is bounded by the number of stretches and of values in two of them.
    """
    spark = left.frame.sparkSession
    one = Side(cut(left.frame.select(*left.columns, left.vector)), left.vector, left.columns)
    two = Side(cut(right.frame.select(*right.columns, right.vector)), right.vector, right.columns)

    def whole(sim: np.ndarray) -> np.ndarray:
        return np.rint(sim * SCALE).astype(np.int64) + SCALE

    def by_stretch(cell: Cell):
        counts = np.bincount((whole(cell.sim) >> STRETCH).ravel())
        at = np.flatnonzero(counts)
        return np.zeros(len(at), np.int64), None, {"__key": at, "__c": counts[at]}

    found = compare(one, two, by_stretch, KEYED, per_left=True, **layout).rows.groupBy("__key").agg(F.sum("__c").alias("__c")).toArrow().sort_by("__key")
    stretches, upto = found["__key"].to_numpy(), np.cumsum(found["__c"].to_numpy())
    if not len(upto):
        drop_table(spark, one.frame, two.frame)
        return left.frame.limit(0).select(group, F.lit(0).cast("long").alias("pairs"), F.lit(0).cast("long").alias("above"))
    position = (int(upto[-1]) - 1) * q
    ranks = np.array([math.floor(position), math.ceil(position)])
    picked = np.searchsorted(upto, ranks, side="right")
    low, high = int(stretches[picked[0]]) << STRETCH, int(stretches[picked[1]] + 1) << STRETCH
    below = int(upto[picked[0]] - found["__c"][picked[0]].as_py())

    def by_group(cell: Cell):
        at = cell.left[group].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        names, first = np.unique(at, return_index=True)
        key = whole(cell.sim)
        over = np.bincount(at, (key >= high).sum(axis=1), len(names)).astype(np.int64)
        under = np.bincount(at, (key < low).sum(axis=1), len(names)).astype(np.int64)
        li, ri = np.nonzero((key >= low) & (key < high))
        inside, n = np.unique(at[li] * (high - low) + key[li, ri] - low, return_counts=True)
        own, place = np.divmod(inside, high - low)
        # What lies below and above the stretch is listed at its edges.
        owner = np.concatenate([np.arange(len(names)), np.arange(len(names)), own])
        keys = np.concatenate([np.full(len(names), low - 1), np.full(len(names), high), place + low])
        return first[owner], None, {"__key": keys, "__c": np.concatenate([under, over, n])}

    counts = cut(compare(one, two, by_group, KEYED, per_left=True, **layout).rows.groupBy(group, "__key").agg(F.sum("__c").alias("__c")))
    drop_table(spark, one.frame, two.frame)
    inside = counts.where((F.col("__key") >= low) & (F.col("__key") < high)).groupBy("__key").agg(F.sum("__c").alias("__c")).toArrow().sort_by("__key")
    values = inside["__key"].to_numpy()[np.searchsorted(np.cumsum(inside["__c"].to_numpy()), ranks - below, side="right")]
    first, last = (values - SCALE) / SCALE
    bound = first + (position - math.floor(position)) * (last - first)
    return counts.groupBy(group).agg(
        F.sum("__c").alias("pairs"), F.sum(F.when((F.col("__key") - SCALE) / SCALE > F.lit(float(bound)), F.col("__c")).otherwise(0)).alias("above")
    )
