"""All registered queries: name -> (query, DuckDB SQL or None)."""

from collections.abc import Callable

REGISTRY: dict = {}


def register(name: str, sql: str | None = None) -> Callable:
    """Decorator: adds a query (spark, sf_dir) -> DataFrame under its operator id and name."""

    def add(query: Callable) -> Callable:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = (query, sql)
        return query

    return add


def load() -> dict:
    """Imports every module of queries, then returns the registry."""
    from riskloom.plans import decisions, etl, models, quality, reports, scalars, streams  # noqa: F401

    return REGISTRY
