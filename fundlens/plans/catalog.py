"""Query catalog: ``name -> (spark, sf_dir) -> DataFrame`` and their
DuckDB oracle SQL. Every query reads the driver tables through the
stand-in adapter, so its work grows with them.

``QUERIES`` round doubles to 8 decimals (the oracle does the same) so that
last-bit differences between engines do not count as mismatches; ``FULL``
holds the same queries in full precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundlens.plans import oracle as O
from fundlens.plans.context import Ctx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FULL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Ctx], DataFrame]):
        def full(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Ctx(spark, sf_dir))

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(full(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        FULL[name] = full
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 8) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def sql_select_rounded(cols: list[tuple[str, bool]], src: str, where: str = "") -> str:
    """SELECT list with ``r8`` applied to the double columns."""
    items = [f"{O.r8(c)} AS {c}" if dbl else c for c, dbl in cols]
    return f"SELECT {', '.join(items)} FROM {src} {where}"


