"""Registration of queries and access to the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .roles import ROLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


class Tables:
    """The tables of one scale factor by name, and the role views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._frames: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(self.path(name))
        return self._frames[name]

    def role(self, name: str) -> DataFrame:
        if name not in self._frames:
            text = ROLES[name]
            used = set(_PLACEHOLDER.findall(text))
            frames = {t: self.role(t) if t in ROLES else getattr(self, t) for t in used}
            self._frames[name] = self.spark.sql(text, **frames)
        return self._frames[name]


def with_roles(sql: str) -> str:
    """Put the roles a statement names in braces in front of it as CTEs."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in ROLES and name not in order:
            for inner in _PLACEHOLDER.findall(ROLES[name]):
                add(inner)
            order.append(name)

    for name in _PLACEHOLDER.findall(sql):
        add(name)
    body = _PLACEHOLDER.sub(lambda m: m.group(1), sql).strip()
    ctes = [f"{n} AS ({_PLACEHOLDER.sub(lambda m: m.group(1), ROLES[n]).strip()})" for n in order]
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` and its oracle."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_roles(sql)
        return fn
    return register


def u(key: str, lane: int = 0) -> str:
    """SQL of the uniform draw from lane 0–3 of the digest of a text key."""
    return (f"(CAST('0x' || substr(md5({key}), {1 + 8 * lane}, 8) AS BIGINT)"
            f" / CAST(4294967296 AS DOUBLE))")


def normal(u0: str, u1: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {u0})) * cos(2.0 * pi() * {u1}))"
