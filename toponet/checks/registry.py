"""Registered queries and their oracle text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixture_sql import FIXTURE_SQL
from ..fixtures import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_NAME = re.compile(r"\bfx_\w+")


def with_views(body: str) -> str:
    """Prefix ``body`` with the derived views it mentions, as CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in FIXTURE_SQL and name not in needed:
                visit(FIXTURE_SQL[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{name} as ({FIXTURE_SQL[name].strip()})" for name in needed)
    body = body.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


def check(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name`` with optional oracle."""

    def register(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
