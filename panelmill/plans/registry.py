"""Query registry and the text helpers of the SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelmill.plans.sqlviews import SQL_VIEWS
from panelmill.plans.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(tables)` under `name`, with its DuckDB twin."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            TWINS[name] = with_views(sql)
        return fn

    return register


def expand_snaps(sql: str) -> str:
    """SNAP6(e) and SNAP9(e) are the floor form of rounding, the same text in both engines."""
    for token, scale in (("SNAP6(", "1e6"), ("SNAP9(", "1e9")):
        while token in sql:
            start = sql.index(token)
            depth, i = 1, start + len(token)
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[i], 0)
                i += 1
            inner = sql[start + len(token) : i - 1]
            sql = f"{sql[:start]}(floor(({inner}) * {scale} + 0.5) / {scale}){sql[i:]}"
    return sql


def with_views(sql: str) -> str:
    """Prepend the views a query names, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in SQL_VIEWS:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(SQL_VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    body = sql.strip()
    ctes = [f"{n} AS ({SQL_VIEWS[n].strip()})" for n in order]
    if not ctes:
        return expand_snaps(body)
    if body.upper().startswith("WITH "):
        return expand_snaps("WITH " + ",\n".join(ctes) + ",\n" + body[5:])
    return expand_snaps("WITH " + ",\n".join(ctes) + "\n" + body)
