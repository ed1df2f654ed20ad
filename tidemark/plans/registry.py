"""Registered queries and the SQL they are checked against."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.oracle_ctes import CTES
from tidemark.sources.derive import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _needed(text: str, found: list[str]) -> None:
    for name, body in CTES.items():
        if name not in found and re.search(rf"\b{name}\b", text):
            _needed(body, found)
            if name not in found:
                found.append(name)


def oracle(body: str) -> str:
    """Prefix a SQL body with the shared derived tables it mentions."""
    found: list[str] = []
    _needed(body, found)
    extra = re.match(r"\s*WITH\s+(RECURSIVE\s+)?(.*)", body, re.S | re.I)
    recursive = "RECURSIVE " if extra and extra.group(1) else ""
    prelude = ",\n".join(f"{n} AS ({CTES[n]})" for n in found)
    if not prelude:
        return body
    if extra:
        return f"WITH {recursive}{prelude},\n{extra.group(2)}"
    return f"WITH {prelude}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return wrap


def r6(x: str, alias: str | None = None, digits: int = 6) -> str:
    """SQL rounding without a negative zero."""
    return f"(round({x}, {digits}) + 0.0)" + (f" AS {alias}" if alias else "")
