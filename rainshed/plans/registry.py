"""Registry of queries: a Spark function, the survey rows it covers and the equivalent SQL.

``out`` names and types the result once for both engines, e.g. ``"receptor_id:i date:d mean:f"``:
i bigint, s string, b boolean, d date, f/f2/f9 a double kept to 6/2/9 decimals.  Doubles are cut just off
the half-way point so that a last-bit difference in summation order cannot flip a kept digit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    rows: tuple[str, ...]
    out: tuple[tuple[str, str], ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        return df.select(*[_spark_cast(F.col(n), t).alias(n) for n, t in self.out])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(f"{_sql_cast(n, t)} AS {n}" for n, t in self.out)
        return f"SELECT {cols} FROM ({self.sql.strip()}) AS result"


REGISTRY: dict[str, Query] = {}


def _digits(t: str) -> int:
    return int(t[1:] or 6)


def _spark_cast(c: Column, t: str) -> Column:
    if t[0] == "f":
        scale = 10.0 ** _digits(t)
        return F.floor(c.cast("double") * scale + 0.4997) / scale
    return c.cast({"i": "bigint", "s": "string", "b": "boolean", "d": "date"}[t])


def _sql_cast(n: str, t: str) -> str:
    if t[0] == "f":
        scale = f"1e{_digits(t)}"
        return f"floor(CAST({n} AS DOUBLE) * {scale} + 0.4997) / {scale}"
    return f"CAST({n} AS {dict(i='BIGINT', s='VARCHAR', b='BOOLEAN', d='DATE')[t]})"


def query(rows: str, out: str, sql: str | None = None, name: str | None = None):
    """Decorator: register ``fn(spark, sf_dir)`` under its own name."""
    spec = tuple((p.split(":")[0], p.split(":")[1]) for p in out.split())

    def add(fn):
        key = name or fn.__name__
        assert key not in REGISTRY, key
        REGISTRY[key] = Query(key, tuple(rows.split()), spec, fn, sql)
        return fn

    return add
