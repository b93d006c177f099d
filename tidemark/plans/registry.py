"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its oracle SQL if it has one."""

    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = with_views(sql)
        return query

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round results, since sums of doubles depend on the order of rows."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def with_views(body: str) -> str:
    """Put the view definitions a query uses, directly or not, in front of it."""
    from tidemark.plans.oracle_views import VIEWS

    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, definition in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(definition)

    visit(body)
    if not needed:
        return body
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    joiner = ",\n" if body.lstrip().upper().startswith("WITH ") else "\n"
    rest = re.sub(r"^\s*WITH\s+(RECURSIVE\s)?", "", body, count=1, flags=re.IGNORECASE) if joiner == ",\n" else body
    recursive = "RECURSIVE " if re.match(r"\s*WITH\s+RECURSIVE\s", body, flags=re.IGNORECASE) else ""
    return f"WITH {recursive}{views}{joiner}{rest}"
