"""One registry entry = Spark callable + output columns + (where SQL can say it) the SQL statement.

The column list is applied to both sides: it fixes names, rounding and integer widths.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tickloom.functions.columns import HALF_SHIFT, rounded
from tickloom.sources.fixtures import duck_views, view

View = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[View], DataFrame]
    columns: str
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(self.build(lambda v: view(spark, sf_dir, v)), self.columns)


_QUERIES: dict[str, Query] = {}


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def query(name: str, columns: str, views: str = "", sql: str | None = None,
          ctes: dict[str, str] | None = None):
    """Register ``fn(view)``. ``sql`` selects the result; ``views`` and ``ctes`` go in front of it."""

    def register(fn: Callable[[View], DataFrame]):
        text = None
        if sql is not None:
            parts = [f"{n} AS MATERIALIZED (\n{s}\n)" for n, s in duck_views(*views.split())]
            parts += [f"{n} AS (\n{s}\n)" if "(" not in n else f"{n}\n{s}\n)"
                      for n, s in (ctes or {}).items()]
            parts.append(f"answer AS (\n{sql.strip()}\n)")
            text = ("WITH RECURSIVE " + ",\n".join(parts)
                    + f"\nSELECT {_duck_projection(columns)} FROM answer")
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = Query(name, fn, columns, text)
        return fn

    return register


def _duck_projection(columns: str) -> str:
    out = []
    for item in columns.split():
        name, _, kind = item.partition(":")
        if kind == "i":
            out.append(f'CAST("{name}" AS BIGINT) AS "{name}"')
        elif kind == "s":
            out.append(f'CAST("{name}" AS VARCHAR) AS "{name}"')
        elif kind:
            shift = HALF_SHIFT * 10.0 ** -int(kind)
            out.append(f'round(CAST("{name}" AS DOUBLE) + CAST({shift!r} AS DOUBLE), {kind}) + 0.0 AS "{name}"')
        else:
            out.append(f'"{name}"')
    return ", ".join(out)
