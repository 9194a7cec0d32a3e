"""Column-set helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def across_columns(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply one column function to a set of columns (B5), in one projection."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def select_by_prefix(df: DataFrame, keep: Sequence[str], *prefixes: str) -> DataFrame:
    """Keep ``keep`` plus every column whose name starts with a prefix."""
    return df.select(*keep, *[c for c in df.columns if c.startswith(prefixes) and c not in keep])
