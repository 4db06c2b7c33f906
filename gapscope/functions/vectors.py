"""Vector arithmetic on ``array<double>`` columns.

These expressions are the row-local forms (parse, scale, blend). Anything that
compares two sets of vectors goes through ``gapscope.operators.similarity``,
which multiplies matrices block by block.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapscope.functions.text import let

NORM_FLOOR = 1e-10


def parse_vector(c: Column) -> Column:
    """Vector from JSON text; null or malformed text gives null."""
    return F.from_json(c, "array<double>")


def as_doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column) -> Column:
    """Scale to length one; a zero vector stays as it is."""

    def scaled(u: Column) -> Column:
        return let(
            F.when(norm(u) > 0, norm(u)).otherwise(1.0), lambda n: F.transform(u, lambda x: x / n)
        )

    return let(v, scaled)


def mix(a: Column, b: Column, wa: float, wb: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x * wa + y * wb)


def combine(a: Column, b: Column, wa: float = 0.4, wb: float = 0.6) -> Column:
    """Weighted mean scaled to length one; the one present if the other is null.

    If the two cancel out, the first is returned.
    """
    def blend(mixed: Column) -> Column:
        return let(
            norm(mixed),
            lambda n: F.when(n < NORM_FLOOR, a).otherwise(F.transform(mixed, lambda x: x / n)),
        )

    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(let(mix(a, b, wa, wb), blend))


def incident_problem_vector(generic: Column, subject: Column, detail: Column) -> Column:
    """Detail alone under a generic subject, else the blend of what is there."""
    return F.when(generic & detail.isNotNull(), detail).otherwise(combine(subject, detail))


def workorder_problem_vector(
    boilerplate: Column, subject: Column, clean_detail: Column, activity: Column
) -> Column:
    return (
        F.when(subject.isNotNull() & clean_detail.isNotNull(), combine(subject, clean_detail))
        .when(boilerplate & activity.isNotNull(), activity)
        .otherwise(subject)
    )


def cluster_vector(problem: Column, resolution: Column) -> Column:
    """The vector tickets are clustered on: even blend, or the problem alone."""
    return normalise(F.when(resolution.isNull(), problem).otherwise(mix(problem, resolution, 0.5, 0.5)))


def kb_side_vector(problem: Column, resolution: Column) -> Column:
    """The vector tickets are compared to articles with: resolution, or the problem."""
    return normalise(F.coalesce(resolution, problem))
