"""Names, plans and SQL twins of the registered queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gapscope.queries.roles import Tables
from gapscope.queries.sql_roles import ROLES

Plan = Callable[[Tables], DataFrame]
PLANS: dict[str, Plan] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; ``sql`` may use the role names of ``sql_roles`` as tables."""

    def keep(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            TWINS[name] = with_roles(sql)
        return plan

    return keep


def with_roles(sql: str) -> str:
    """Put the definitions of the roles a statement uses in front of it."""
    order: list[str] = []

    def need(text: str) -> None:
        for role, body in ROLES.items():
            if role not in order and re.search(rf"\b{role}\b", text):
                need(body)
                if role not in order:
                    order.append(role)

    need(sql)
    sql = sql.strip()
    if not order:
        return sql
    ctes = ",\n".join(f"{r} AS (\n{ROLES[r].strip()}\n)" for r in order)
    if sql.lower().startswith("with recursive "):
        return f"WITH RECURSIVE {ctes},\n{sql[15:]}"
    if sql.lower().startswith("with "):
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"


def runner(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: plan(Tables(spark, folder))
