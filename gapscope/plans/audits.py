"""Audit tables: service distribution, flag counts before and after, bias, personal data."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscope.functions.text import ID_NUMBER, MAIL_ADDRESS, PHONE_NUMBER

FLAGS = ("CRITICAL", "PARTIAL", "COVERED")
# Kind, pattern, severity.
PERSONAL_DATA = (
    ("Email address", MAIL_ADDRESS, "HIGH"),
    ("Phone number", PHONE_NUMBER, "HIGH"),
    ("ID number", ID_NUMBER, "MEDIUM"),
)


def flagged_counts(assignments: DataFrame, gaps: DataFrame) -> DataFrame:
    """Tickets per run, service type and flag (``n``); counted per cluster before any join."""
    counted = assignments.groupBy("run_id", "cluster_id", "service_type").agg(F.count("*").alias("n"))
    flags = gaps.select("run_id", "cluster_id", "gap_flag")
    return counted.join(flags, ["run_id", "cluster_id"]).groupBy("run_id", "service_type", "gap_flag").agg(F.sum("n").alias("n"))


def service_distribution(assignments: DataFrame, gaps: DataFrame) -> DataFrame:
    """Tickets per service type and flag, one row per service type of a run."""
    return flagged_counts(assignments, gaps).groupBy("run_id", "service_type").agg(
        *[F.sum(F.when(F.col("gap_flag") == f, F.col("n")).otherwise(0)).alias(f.lower()) for f in FLAGS], F.sum("n").alias("total")
    )


def coverage_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Clusters per flag before and after, with the difference."""
    count = lambda df, name: df.where(F.col("gap_flag").isin(*FLAGS)).groupBy(
        "run_id", F.col("gap_flag").alias("flag")
    ).agg(F.count("*").alias(name))
    both = count(before, "count_before").join(count(after, "count_after"), ["run_id", "flag"], "full_outer").fillna(0)
    return both.withColumn("delta", F.col("count_after") - F.col("count_before"))


def bias_statistic(assignments: DataFrame, gaps: DataFrame) -> DataFrame:
    """Chi-square of service type against flag per run, and the service furthest above its share.

    ``sum (o - e)^2 / e`` equals ``n (sum o^2 / (row col) - 1)``, so empty cells need no rows.
    """
    cells = flagged_counts(assignments, gaps).withColumnRenamed("n", "o")
    rows = cells.groupBy("run_id", "service_type").agg(F.sum("o").alias("row"))
    cols = cells.groupBy("run_id", "gap_flag").agg(F.sum("o").alias("col"))
    shape = rows.groupBy("run_id").agg(F.sum("row").alias("n"), F.count("*").alias("r")).join(
        cols.groupBy("run_id").agg(F.count("*").alias("c")), "run_id"
    )
    joined = cells.join(rows, ["run_id", "service_type"]).join(cols, ["run_id", "gap_flag"]).join(shape, "run_id")
    critical = F.when(F.col("gap_flag") == "CRITICAL", F.col("o") - F.col("row") * F.col("col") / F.col("n"))
    return joined.groupBy("run_id").agg(
        (F.max("n") * (F.sum(F.col("o") * F.col("o") / (F.col("row") * F.col("col"))) - 1)).alias("statistic"),
        ((F.max("r") - 1) * (F.max("c") - 1)).alias("degrees_of_freedom"),
        # Only CRITICAL cells take part; a run without any has no most affected service.
        F.max_by("service_type", F.when(F.col("gap_flag") == "CRITICAL", F.struct(F.round(critical, 6), F.col("service_type")))).alias("most_affected"),
    )


def chi_square_tail(statistic: Column, degrees: Column) -> Column:
    """Chance of a larger chi-square value: 1 less the series of the incomplete gamma function.

    More than 100 above the degrees of freedom it is below 1e-12 and given as 0.
    """
    a, h = degrees / 2, statistic / 2
    falling = F.transform(F.sequence(F.lit(0), F.ceil(a).cast("int") - 1), lambda k: F.log(a - k))
    log_gamma = F.aggregate(falling, F.lit(0.0), lambda s, x: s + x) + F.when(a != F.floor(a), 0.5 * math.log(math.pi)).otherwise(0.0)
    first = F.exp(a * F.log(h) - h - log_gamma)
    more = F.aggregate(
        F.sequence(F.lit(1), F.ceil(2 * h + 200).cast("int")),
        F.struct(first.alias("term"), first.alias("sum")),
        lambda s, n: F.struct((s["term"] * h / (a + n)).alias("term"), (s["sum"] + s["term"] * h / (a + n)).alias("sum")),
        lambda s: s["sum"],
    )
    return F.when((degrees <= 0) | (statistic <= 0), 1.0).when(h > a + 50, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - more))


def bias_p_value(assignments: DataFrame, gaps: DataFrame, level: float = 0.05) -> DataFrame:
    """Chi-square test of each run: statistic, degrees of freedom, p, and whether it is significant."""
    named = assignments.withColumn("service_type", F.coalesce("service_type", F.lit("Unknown")))
    tested = bias_statistic(named, gaps).withColumn("p_value", chi_square_tail(F.col("statistic"), F.col("degrees_of_freedom")))
    return tested.select(
        "run_id", F.lit("chi2_contingency").alias("test_name"), "statistic", "degrees_of_freedom", "p_value",
        (F.col("p_value") < level).alias("bias_detected"),
    )


def personal_findings(articles: DataFrame, fields: Sequence[str] = ("title", "problem_statement", "resolution_steps", "additional_notes")) -> DataFrame:
    """One row per match of a personal-data pattern in a field of an article."""
    text = lambda f: (
        F.array_join(f, "\n") if articles.schema[f].dataType.typeName() == "array" else F.col(f)
    )
    held = articles.select(
        "run_id", "article_id", "cluster_id",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), text(f).alias("value")) for f in fields])).alias("f"),
    )

    def tagged(kind: str, pattern: str, level: str):
        found = F.regexp_extract_all("f.value", F.lit(pattern), F.lit(0))
        return F.transform(
            found, lambda m: F.struct(F.lit(kind).alias("pii_type"), F.lit(level).alias("severity"), m.alias("match"))
        )

    hits = F.concat(*[tagged(*p) for p in PERSONAL_DATA])
    return held.select("run_id", "article_id", "cluster_id", "f.field", F.explode(hits).alias("h")).select(
        "run_id", "article_id", "cluster_id", "field", "h.pii_type", "h.severity", "h.match"
    )
