"""Counters of the steps, taken in the pass that writes their tables.

A counter is an aggregate over a table's rows. The same definitions make the count queries
(``row``) and are observed while a table is written (``watched``), so counting reads nothing a
second time. They are observed right below the write, in the write's own tasks: of a task that
runs again only the attempt that succeeds is counted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Counters = Mapping[str, Column]
DROP_REASONS = {"no_vector": "no-vector", "short": "short", "no_detail": "no-detail", "boilerplate": "boilerplate", "email": "email"}
FLAGS = ("CRITICAL", "PARTIAL", "COVERED", "DUPLICATE")


def row(df: DataFrame, counters: Counters) -> DataFrame:
    return df.agg(*[c.alias(name) for name, c in counters.items()])


def watched(df: DataFrame, counters: Counters) -> tuple[DataFrame, Observation]:
    """``df`` and what will hold its counters once it has been written."""
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in counters.items()]), seen


def funnel(of: Column | None = None) -> dict[str, Column]:
    """Rows in all, usable ones, and rows per first failing rule, of the rows where ``of`` holds."""
    among = F.lit(True) if of is None else of
    reasons = {name: F.count_if(among & (F.col("drop_reason") == reason)) for name, reason in DROP_REASONS.items()}
    return {"total": F.count_if(among), "usable": F.count_if(among & F.col("quality_pass")), **reasons}


def by_source() -> dict[str, Column]:
    parts = {"incident": "incidents", "workorder": "workorders"}
    return {f"{name}_{many}": c for one, many in parts.items() for name, c in funnel(F.col("source") == one).items()}


def values(column: str, known: tuple[str, ...]) -> dict[str, Column]:
    return {v.lower(): F.count_if(F.col(column) == v) for v in known}


def opinions() -> dict[str, Column]:
    """Clusters asked about, matches by confidence, no match, overrides, failed calls."""
    match, level = F.col("match_found"), F.upper("confidence")
    sure = {f"matches_{name.lower()}": F.count_if(match & (level == name)) for name in ("HIGH", "MEDIUM", "LOW")}
    override = match & (level == "HIGH") & (F.col("matched_kb_title") != "")
    return {
        "asked": F.count("*"), "validated": F.count("match_found"), **sure, "no_match": F.count_if(~match),
        "overrides": F.count_if(override), "failed": F.count_if(match.isNull()),
    }


def of_table(name: str) -> dict[str, Column]:
    """The counters of a stored table; none for tables that have none of their own."""
    if name == "ticket_embeddings":
        return by_source()
    if name == "ticket_coverage":
        return {"total": F.count("*"), **values("coverage", ("COVERED", "PARTIAL", "UNCOVERED"))}
    if name == "gap_analysis":
        return {"total": F.count("*"), **values("gap_flag", FLAGS)}
    if name == "generated_kb_articles":
        return {"total": F.count("*"), "inserted": F.count("article_embedding")}
    if name == "kb_validation_results":
        return {"total": F.count("*"), **values("validation_status", ("VALIDATED", "PARTIAL", "FAIL"))}
    return {}
