"""Bindings of the operators to the input tables, one named query each."""

from importlib import import_module

from tidewell.plans.registry import QUERIES, SQL

FAMILIES = [
    "scalars", "relational", "joins", "aggregates", "series", "sources", "changes", "text", "models", "offers", "streams",
]


def _register() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")


def all_queries():
    _register()
    return dict(QUERIES)


def all_sql():
    _register()
    return dict(SQL)
