"""The registry of queries and of the DuckDB SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplegrid.plans import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def color_query(name: str, f, sql: tuple[str, ...], digits: int | None = 6) -> None:
    """A query of f(r, g, b) over rgb_lines, as columns c0, c1, ...: whole numbers, or doubles rounded to `digits` places."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f("r", "g", "b")
        cast = (lambda c: c.cast("int")) if digits is None else (lambda c: F.round(c, digits) + 0.0)
        return fx.rgb_lines(spark, sf_dir).select("k1", "k2", *(cast(c).alias(f"c{i}") for i, c in enumerate(out)))

    cast = "({})::int" if digits is None else f"round({{}}, {digits}) + 0.0"
    add(name, query, f"with {fx.RGB_LINES} select k1, k2, " + ", ".join(f"{cast.format(s)} c{i}" for i, s in enumerate(sql)) + " from c")


def clip_sql(s: str) -> str:
    return f"trunc(least(greatest({s}, 0), 255))"
