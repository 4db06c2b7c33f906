"""Ticket counts of a run at all levels the reports ask for, from one reading of the assignments.

Assignments are counted once per run, cluster, source and service; that small table meets flags and
sizes, and grouping sets give the levels. A row says its level; columns outside it are null.
The table is stored once per run, and every count of the dashboard is a filter or a small sum of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscope.plans import reports as rp

DIMENSIONS = ("run_id", "cluster_id", "source", "service_type", "gap_flag")
#: Level -> the columns it is grouped by.
LEVELS = {
    "cluster": ("run_id", "cluster_id", "gap_flag"),
    "cluster_source": ("run_id", "cluster_id", "source"),
    "source": ("run_id", "source"),
    "service_flag": ("run_id", "service_type", "gap_flag"),
    "source_service_flag": ("run_id", "source", "service_type", "gap_flag"),
    "flag": ("run_id", "gap_flag"),
    "run": ("run_id",),
}


def rollup(assignments: DataFrame, gaps: DataFrame) -> DataFrame:
    """run_id, level, the other dimensions and ``tickets``; ``gaps`` has the flag of every cluster of a run.

    Clusters without tickets have a row of 0 at the levels of clusters and flags. Tickets of a
    cluster without a flag count where no flag is asked for, and stand under a null flag elsewhere.
    """
    fine = assignments.groupBy("run_id", "cluster_id", "source", "service_type").agg(F.count("*").alias("n"))
    flags = gaps.select("run_id", "cluster_id", "gap_flag")
    both = fine.withColumn("held", F.lit(True)).join(flags, ["run_id", "cluster_id"], "full")
    dims = [F.col(d) for d in DIMENSIONS]
    sums = both.groupingSets([[F.col(c) for c in columns] for columns in LEVELS.values()], *dims).agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("tickets"), F.grouping_id().alias("out"),
        F.count(F.when(F.col("held"), 1)).alias("held"),
    )
    level = F.lit(None).cast("string")
    for name, columns in LEVELS.items():
        # The grouping id has a bit for every dimension left out, the first one highest.
        bits = sum(1 << (len(DIMENSIONS) - 1 - i) for i, d in enumerate(DIMENSIONS) if d not in columns)
        level = F.when(F.col("out") == bits, name).otherwise(level)
    wide = sums.withColumn("level", level)
    # Levels of sources and services are about tickets: no rows for clusters that hold none.
    about_tickets = F.col("level").isin("cluster_source", "source", "service_flag", "source_service_flag")
    return wide.where(~about_tickets | (F.col("held") > 0)).select("run_id", "level", *DIMENSIONS[1:], "tickets")


def at(table: DataFrame, level: str) -> DataFrame:
    return table.where(F.col("level") == level).select(*LEVELS[level], "tickets")


def source_counts(table: DataFrame) -> DataFrame:
    return at(table, "cluster_source").groupBy("run_id", "cluster_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("source") == s, F.col("tickets"))), F.lit(0)).alias(n) for s, n in (("workorder", "wo_tickets"), ("incident", "inc_tickets"))]
    )


def source_mix(table: DataFrame) -> DataFrame:
    return at(table, "source")


def source_mix_per_cluster(table: DataFrame, clusters: DataFrame) -> DataFrame:
    names = clusters.select("run_id", "cluster_id", "cluster_label")
    return at(table, "cluster_source").join(names, ["run_id", "cluster_id"]).select("run_id", "cluster_id", "cluster_label", "source", "tickets")


def workorder_clusters(table: DataFrame) -> DataFrame:
    return rp.workorder_counts(source_counts(table))


def incident_dominant(table: DataFrame, clusters: DataFrame) -> DataFrame:
    total = clusters.groupBy("run_id").agg(F.count("*").alias("total_clusters"))
    joined = total.join(workorder_clusters(table), "run_id", "left").fillna(0)
    return joined.withColumn("inc_dominant", F.col("total_clusters") - F.col("wo_dominant"))


def service_breakdown(table: DataFrame, source: str | None = None) -> DataFrame:
    rows = at(table, "source_service_flag").where(F.col("source") == source).drop("source") if source else at(table, "service_flag")
    return rows.where("gap_flag is not null").orderBy(F.desc("tickets"), "run_id", "service_type", "gap_flag")


def service_pivot(table: DataFrame) -> DataFrame:
    return rp.service_pivot(service_breakdown(table))


def source_pivot(table: DataFrame, clusters: DataFrame) -> DataFrame:
    return rp.source_pivot(source_mix_per_cluster(table, clusters))


def gap_distribution(table: DataFrame) -> DataFrame:
    """Clusters and tickets per flag, the tickets as assigned."""
    return at(table, "cluster").where("gap_flag is not null").groupBy("run_id", "gap_flag").agg(F.count("*").alias("clusters"), F.sum("tickets").alias("tickets"))


def flag_totals(table: DataFrame) -> DataFrame:
    return rp.flag_totals(at(table, "cluster").where("gap_flag is not null"))
