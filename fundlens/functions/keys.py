"""Key builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def composite_key(*parts: ColumnOrName, sep: str = "_", missing: str | None = "NA") -> Column:
    """Join code columns into one string key.

    ``missing='NA'`` writes the text NA for a missing part (the facts/dims
    key); ``missing=None`` makes the whole key NULL when any part is NULL
    (the report key). ``concat_ws`` is avoided: it silently skips NULLs.
    """
    cols = [_c(p).cast("string") for p in parts]
    if missing is not None:
        cols = [F.coalesce(c, F.lit(missing)) for c in cols]
    return null_concat(*cols, sep=sep)


def null_concat(*parts: ColumnOrName, sep: str = "") -> Column:
    """NULL-propagating concatenation with a separator."""
    out: list[Column] = []
    for i, p in enumerate(parts):
        if i and sep:
            out.append(F.lit(sep))
        out.append(_c(p).cast("string"))
    return F.concat(*out)


def series_label(fund: ColumnOrName, participation: ColumnOrName) -> Column:
    """``Fondo/Participacion`` display label (B7); NULL if either part is NULL."""
    return null_concat(fund, participation, sep="/")
