"""Join helpers (D1-D3, D6, D7, D9) that keep the left frame's column order.

``join(on=[...])`` moves the key columns to the front; positional renames
downstream depend on a stable order, so semi/anti joins re-select the
left columns (a projection, free in the plan).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def semi(df: DataFrame, other: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    """Rows of ``df`` with a match in ``other`` on ``keys`` (EXISTS)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.join(other.select(*keys), keys, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])


def anti(df: DataFrame, other: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    """Rows of ``df`` without a match in ``other`` on ``keys`` (NOT EXISTS)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.join(other.select(*keys), keys, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def natural_left(df: DataFrame, other: DataFrame) -> DataFrame:
    """Left join on all common columns."""
    common = [c for c in df.columns if c in other.columns]
    if not common:
        raise ValueError("natural join needs at least one common column")
    out = df.join(other, common, "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns],
                      *[F.col(f"`{c}`") for c in other.columns if c not in common])


def left_lookup(df: DataFrame, other: DataFrame, keys: Sequence[str] | str,
                drop: Sequence[str] = ()) -> DataFrame:
    """Left join keeping the left order first, minus ``drop`` columns."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    o = other.drop(*drop)
    out = df.join(o, keys, "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns],
                      *[F.col(f"`{c}`") for c in o.columns if c not in keys])


def align_prediction(pred: DataFrame, actual: DataFrame, keys: Sequence[str] = ("cod", "fecha_corte"),
                     value: str = "creci_dia") -> DataFrame:
    """Prediction next to the actual value by key, not by position."""
    a = actual.select(*keys, F.col(value).alias("actual"))
    return pred.join(a, list(keys), "inner")
