"""Queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .frames import CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_frames(sql: str) -> str:
    """sql with the common table expressions that it names put before it."""
    need: list[str] = []

    def add(text: str) -> None:
        for name, body in CTES.items():
            if name not in need and f"{{{name}}}" in text:
                add(body)
                need.append(name)

    add(sql)
    strip = lambda text: re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in CTES else m[0], text)
    sql = strip(sql)
    if not need:
        return sql
    # materialised, as a frame that is named twice would be worked out twice
    head = ", ".join(f"{n} AS MATERIALIZED ({strip(CTES[n])})" for n in need)
    body, start = sql.strip(), re.match(r"WITH\s+(RECURSIVE\s+)?", sql.strip(), re.IGNORECASE)
    return f"WITH {start[1] or ''}{head}, {body[start.end():]}" if start else f"WITH {head} {body}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_frames(sql)
        return f

    return add
