"""Trailing rolling statistics over a series.

All frames are trailing ``rowsBetween(-(p-1), 0)`` on the series window and
are NULL until the frame holds ``p`` non-NULL values (a NULL inside the
frame makes the result NULL, as in the source's ``prod``/``sd``).

Products and spreads use one method for every ``p``, O(n) and without
cancellation: the series is cut into blocks of ``p`` rows, so a trailing frame
is the tail of one block and the head of the next. Statistics of each head and
each tail are running aggregates (count, mean, squared deviations, product),
and the two parts are combined. A value only enters frames that contain it: a
huge or not-a-number day leaves no trace in later frames.

All windows partition by the series (and its blocks), hence no extra shuffle.
``rolling`` evaluates any other aggregate over the plain moving frame.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlens.operators.panel import DATE, SERIES

DAYS_PER_YEAR = 365


def _frame(sk: Sequence[str], dc: str, period: int):
    return (Window.partitionBy(*sk).orderBy(F.col(dc))
            .rowsBetween(-(period - 1), Window.currentRow))


def rolling(df: DataFrame, col: str, period: int, agg: Callable[[Column], Column],
            name: str | None = None, sk: Sequence[str] = SERIES, dc: str = DATE,
            full: bool = True) -> DataFrame:
    """Any Spark aggregate over a trailing frame of ``period`` rows.

    ``agg`` maps the input column to an aggregate expression, e.g.
    ``lambda c: F.max(c)``. With ``full`` the value is NULL unless the frame
    holds ``period`` non-NULL values.
    """
    w = _frame(sk, dc, period)
    value = agg(F.col(col)).over(w)
    if full:
        value = F.when(F.count(F.col(col)).over(w) == period, value)
    return df.withColumn(name or f"{col}_{period}", value)


def _head_tail(df: DataFrame, col: str, period: int, tag: str, sk: Sequence[str], dc: str,
               product: bool, spread: bool) -> DataFrame:
    """Statistics of each row's block from its start to the row (head) and
    from the row to its end (tail), then the tail of the frame's first row
    brought to its last: columns ``_<tag>_h*`` and ``_<tag>_t*``."""
    x = F.col(col).cast("double")
    block = F.floor((F.col("_r_at") - 1) / period)
    df = df.withColumn(f"_{tag}_b", block)
    head = (Window.partitionBy(*sk, f"_{tag}_b").orderBy(F.col(dc))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tail = (Window.partitionBy(*sk, f"_{tag}_b").orderBy(F.col(dc).desc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    aggs = {"n": F.count(x)}
    if product:
        aggs["p"] = F.product(1 + x)
    if spread:
        aggs |= {"m": F.avg(x), "v": F.var_pop(x)}
    df = df.withColumns({f"_{tag}_h{k}": a.over(head) for k, a in aggs.items()})
    df = df.withColumns({f"_{tag}_s{k}": a.over(tail) for k, a in aggs.items()})
    back = Window.partitionBy(*sk).orderBy(F.col(dc))
    whole = F.col("_r_at") % period == 0                  # the frame is one block: the head is all of it
    return df.withColumns({f"_{tag}_t{k}": F.when(~whole, F.lag(f"_{tag}_s{k}", period - 1).over(back)) for k in aggs})


def _full(tag: str, period: int) -> Column:
    """The frame holds ``period`` rows, none of them NULL."""
    n = F.col(f"_{tag}_hn") + F.coalesce(F.col(f"_{tag}_tn"), F.lit(0))
    return (F.col("_r_at") >= period) & (n == period)


def _product(tag: str, period: int) -> Column:
    return F.when(_full(tag, period), F.col(f"_{tag}_hp") * F.coalesce(F.col(f"_{tag}_tp"), F.lit(1.0)))


def _stddev(tag: str, period: int) -> Column:
    """Sample standard deviation from both parts' counts, means and variances; NULL for one row."""
    if period < 2:
        return F.lit(None).cast("double")
    hn, tn = F.col(f"_{tag}_hn"), F.coalesce(F.col(f"_{tag}_tn"), F.lit(0))
    apart = F.col(f"_{tag}_hm") - F.coalesce(F.col(f"_{tag}_tm"), F.col(f"_{tag}_hm"))
    squares = (F.col(f"_{tag}_hv") * hn + F.coalesce(F.col(f"_{tag}_tv"), F.lit(0.0)) * tn
               + apart * apart * (hn * tn / period))
    return F.when(_full(tag, period), F.sqrt(squares / (period - 1)))


def rolling_stats(df: DataFrame, specs: Sequence[tuple[str, str, int, str]],
                  sk: Sequence[str] = SERIES, dc: str = DATE) -> DataFrame:
    """Add trailing-window statistics of the series.

    ``specs`` holds ``(name, kind, period, column)`` with ``kind`` one of
    ``ann`` (annualised return), ``gross`` (gross return), ``vol``
    (annualised volatility). The parts of a (period, column) are computed
    once and shared.
    """
    need: dict[tuple[int, str], set[str]] = {}
    for _, kind, period, col in specs:
        if kind not in ("ann", "gross", "vol"):
            raise ValueError(f"unknown rolling kind {kind!r}")
        need.setdefault((period, col), set()).add("spread" if kind == "vol" else "product")
    out = df.withColumn("_r_at", F.row_number().over(Window.partitionBy(*sk).orderBy(F.col(dc))))
    tags = {}
    for i, ((period, col), kinds) in enumerate(need.items()):
        tags[period, col] = f"r{i}"
        out = _head_tail(out, col, period, f"r{i}", sk, dc, "product" in kinds, "spread" in kinds)
    exprs = {}
    for name, kind, period, col in specs:
        tag = tags[period, col]
        if kind == "ann":
            exprs[name] = F.pow(_product(tag, period), F.lit(DAYS_PER_YEAR / period)) - 1
        elif kind == "gross":
            exprs[name] = _product(tag, period) - 1
        else:
            exprs[name] = _stddev(tag, period) * F.lit(math.sqrt(DAYS_PER_YEAR))
    out = out.withColumns(exprs)
    return out.drop(*[c for c in out.columns if c.startswith("_r") and c not in df.columns])


def rolling_return_ann(df: DataFrame, period: int = 30, col: str = "crecimiento_dia",
                       sk: Sequence[str] = SERIES, dc: str = DATE,
                       name: str | None = None) -> DataFrame:
    """``rent_p = prod(1 + g)^(365/p) - 1`` over the last ``p`` days."""
    return rolling_stats(df, [(name or f"rent_{period}", "ann", period, col)], sk, dc)


def rolling_vol_ann(df: DataFrame, period: int = 30, col: str = "crecimiento_dia",
                    sk: Sequence[str] = SERIES, dc: str = DATE,
                    name: str | None = None) -> DataFrame:
    """``vol_p = sd(g) * sqrt(365)`` over the last ``p`` days (F8)."""
    return rolling_stats(df, [(name or f"vol_{period}", "vol", period, col)], sk, dc)


def rolling_return_gross(df: DataFrame, period: int = 30, col: str = "crecimiento_dia",
                         sk: Sequence[str] = SERIES, dc: str = DATE,
                         name: str | None = None) -> DataFrame:
    """``rent_brut_p = prod(1 + g) - 1``."""
    return rolling_stats(df, [(name or f"rent_brut_{period}", "gross", period, col)], sk, dc)


def rent_vol(df: DataFrame, period: int = 30, col: str = "crecimiento_dia",
             sk: Sequence[str] = SERIES, dc: str = DATE) -> DataFrame:
    """Annualised return and volatility of one period (``rent_p``, ``vol_p``)."""
    return rolling_stats(df, [(f"rent_{period}", "ann", period, col),
                              (f"vol_{period}", "vol", period, col)], sk, dc)


def clamp_period(value, default: int, low: int = 1, high: int = 365) -> int:
    """Dashboard input rule: missing/invalid -> default, else clamp."""
    try:
        v = int(value)
    except (TypeError, ValueError):
        return default
    return max(low, min(high, v))


def multi_period_risk(df: DataFrame, periods: Sequence[int] = (30, 365), col: str = "crecimiento_dia",
                      sk: Sequence[str] = SERIES, dc: str = DATE) -> DataFrame:
    """Return and volatility for several periods in one frame.

    Equal periods are computed once. All expressions share the partitioning,
    so the plan has one exchange for all of them.
    """
    seen: list[int] = []
    for p in periods:
        if p not in seen:
            seen.append(p)
    specs = [(f"rent_{p}", "ann", p, col) for p in seen] + [(f"vol_{p}", "vol", p, col) for p in seen]
    return rolling_stats(df, specs, sk, dc)


def rolling_generic(df: DataFrame, cols: Sequence[str], period: int = 30, value_col: str | None = None,
                    sk: Sequence[str] = ("cod",), dc: str = DATE) -> DataFrame:
    """Annualised rolling return over several columns.

    When ``value_col`` is given, the other columns are first coalesced with
    it (interval bounds missing on actual rows take the actual value).
    """
    out = df
    if value_col is not None:
        out = out.withColumns({c: F.coalesce(F.col(c), F.col(value_col)) for c in cols if c != value_col})
    return rolling_stats(out, [(c, "ann", period, c) for c in cols], sk, dc)
