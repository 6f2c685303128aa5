"""Catalogue of runnable queries: name -> Spark plan over the test tables, and its reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchday.sources.adapter import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan, optionally with DuckDB SQL that must give the same rows."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def with_views(sql: str) -> str:
    """Prefix the views a statement mentions, directly or through other views, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in ordered and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(body)
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    prefix = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    body = sql.strip()
    own = body.startswith("WITH ")
    return f"WITH {prefix}{',' if own else ''}\n{body[5:] if own else body}"


def runnable(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Tables(spark, sf_dir))
