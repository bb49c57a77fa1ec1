"""Named queries and, where SQL can state the result, the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query; ``views`` names the derived views its SQL reads."""
    def add(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(views.split(), sql)
        return fn

    return add


def with_views(names: list[str], body: str) -> str:
    from lurewatch.catalog.views import NEEDS, VIEWS

    ordered: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, []):
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    body = body.strip()
    if not ordered:
        return body
    # A recursive body brings its own WITH list.
    recursive = body.upper().startswith("WITH RECURSIVE")
    plain = body.upper().startswith("WITH ")
    heads = ",\n".join(f"{n} AS (\n{VIEWS[n].strip()}\n)" for n in ordered)
    if recursive:
        return f"WITH RECURSIVE {heads},\n{body[len('WITH RECURSIVE'):].lstrip()}"
    if plain:
        return f"WITH {heads},\n{body[len('WITH'):].lstrip()}"
    return f"WITH {heads}\n{body}"
