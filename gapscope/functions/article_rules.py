"""Rules on drafted articles and on the replies of a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapscope.config import Thresholds

LOW_EVIDENCE_ISSUE = "Insufficient evidence — requires technician review"
LOW_EVIDENCE_NOTE = (
    " [AUTO-STUB: Low evidence quality — technician review required before publishing.]"
)
ABSENT_NOTE = "[AUTO-STUB: Insufficient evidence — requires technician review before publishing.]"
VERDICTS = ("VALIDATED", "PARTIAL", "INSUFFICIENT")


def _faults(steps: Column, problem: Column, escalation: Column, confidence: Column):
    """(condition, issue text, points) of every rule."""
    n = F.coalesce(F.size(steps), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    return (
        (n < 2, "Too few resolution steps", 3),
        (n == 2, "Needs more steps", 1),
        (F.length(F.coalesce(problem, F.lit(""))) < 50, "Problem statement too short", 2),
        (F.coalesce(escalation, F.lit("")) == "", "Missing escalation trigger", 1),
        (F.coalesce(confidence, F.lit(1.0)) < 0.70, "Low model confidence", 1),
    )


def quality_score(steps: Column, problem: Column, escalation: Column, confidence: Column) -> Column:
    """Ten less the points of every fault, never below zero."""
    lost = F.lit(0)
    for fault, _, points in _faults(steps, problem, escalation, confidence):
        lost = lost + F.when(fault, points).otherwise(0)
    return F.greatest(F.lit(0), 10 - lost)


def quality_issues(steps: Column, problem: Column, escalation: Column, confidence: Column) -> Column:
    return F.array_compact(
        F.array(*[F.when(fault, text) for fault, text, _ in _faults(steps, problem, escalation, confidence)])
    )


def low_evidence(evidence: Column, bound: float = Thresholds.low_evidence) -> Column:
    return F.coalesce(evidence, F.lit(0.0)) < bound


def issues_with_evidence(issues: Column, evidence: Column) -> Column:
    return F.when(
        low_evidence(evidence), F.array_append(issues, F.lit(LOW_EVIDENCE_ISSUE))
    ).otherwise(issues)


def notes_with_evidence(notes: Column, evidence: Column, flag: Column) -> Column:
    """Stub note after the notes; a CRITICAL draft without notes gets the longer stub alone."""
    absent = F.when(flag == "CRITICAL", F.lit(ABSENT_NOTE)).otherwise(F.lit(LOW_EVIDENCE_NOTE))
    return F.when(
        low_evidence(evidence),
        F.when(notes.isNull(), absent).otherwise(F.concat(notes, F.lit(LOW_EVIDENCE_NOTE))),
    ).otherwise(notes)


def embedding_text(title: Column, problem: Column, steps: Column) -> Column:
    return F.concat_ws(
        " ",
        F.coalesce(title, F.lit("")),
        F.coalesce(problem, F.lit("")),
        F.coalesce(F.array_join(steps, " "), F.lit("")),
    )


def index_content(*parts: Column) -> Column:
    """Text of a search-index entry: parts joined by blanks, stripped, 500 characters."""
    from gapscope.functions.text import snippet, strip

    return snippet(strip(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])), 500)


def normalise_verdict(c: Column) -> Column:
    upper = F.upper(F.coalesce(c, F.lit("PARTIAL")))
    return F.when(upper.isin(*VERDICTS), upper).otherwise("PARTIAL")


def final_verdict(verdict: Column, novel: Column, aligned: Column, flag: Column) -> Column:
    supplement = flag == "PARTIAL"
    return (
        F.when(verdict == "INSUFFICIENT", "FAIL")
        .when(supplement & (verdict == "VALIDATED") & aligned, "VALIDATED")
        .when(supplement, "PARTIAL")
        .when(~novel & ~aligned, "FAIL")
        .when((verdict == "VALIDATED") & novel & aligned, "VALIDATED")
        .otherwise("PARTIAL")
    )


def fallback_verdict(aligned: Column) -> Column:
    return F.when(aligned, "PARTIAL").otherwise("INSUFFICIENT")
