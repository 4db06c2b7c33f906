"""Registered queries: each name has a Spark plan and, where SQL can say it, a twin in SQL."""

from importlib import import_module

MODULES = ("texts", "coverage", "gaps", "articles", "reports")


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
