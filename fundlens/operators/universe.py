"""Universe screens over series (U1-U8) and the filters/top-k they use
(C2-C5, C8, G3-G5).

Global maxima are scalar subqueries (``DataFrame.scalar()``: evaluated
once, used as a literal, pushed into scans where possible) -- never an
unpartitioned window or a cross join. Per-series statistics are
``groupBy`` aggregates (partial, map-side) semi-joined back on the series
key; on a table bucketed by that key the big side does not move.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlens.operators.joins import semi
from fundlens.operators.panel import DATE, SERIES


def filter_latest_date(df: DataFrame, dc: str = DATE) -> DataFrame:
    """Rows at the global last date."""
    return df.where(F.col(dc) == df.agg(F.max(dc)).scalar())


def active_series(df: DataFrame, sk: Sequence[str] = SERIES, dc: str = DATE) -> DataFrame:
    """Series whose last date equals the global last date."""
    last_by = df.groupBy(*sk).agg(F.max(dc).alias("_last"))
    keep = last_by.where(F.col("_last") == last_by.agg(F.max("_last")).scalar()).select(*sk)
    return semi(df, keep, sk)


def active_long_series(df: DataFrame, days: int = 365, sk: Sequence[str] = SERIES,
                       dc: str = DATE) -> DataFrame:
    """U1 then U2 in one aggregate pass (U4's screen); rows may be runs (column ``dias``).

    Per-series last date and row count in one ``groupBy`` (no exchange when
    ``df`` is already partitioned by the series key); the global last date
    is the max of the per-series maxima, a tiny aggregate.
    """
    days_of = F.sum("dias") if "dias" in df.columns else F.count(F.lit(1))
    per = df.groupBy(*sk).agg(F.max(dc).alias("_last"), days_of.alias("_n"))
    keep = (per.where((F.col("_last") == per.agg(F.max("_last")).scalar()) & (F.col("_n") > days))
            .select(*sk))
    return semi(df, keep, sk)


def screen_universe(df: DataFrame, days: int = 365, base: bool = True, sk: Sequence[str] = SERIES,
                    dc: str = DATE, fund: str = "cod", part: str = "tipo_participacion",
                    investors: str = "numero_inversionistas",
                    value: str = "valor_fondo_cierre_dia_t") -> DataFrame:
    """U1 + U2 (+ U3) from ONE aggregate pass over the panel.

    Per series: last date, row count, and investors / closing value on its
    last date (``max_by``). Active series end on the global last date, so
    their last row *is* the last-day row the base-share rule looks at. The
    selection runs on the small per-series table; the panel is read once
    more for the final semi join. Rows may be runs (column ``dias``).
    """
    days_of = F.sum("dias") if "dias" in df.columns else F.count(F.lit(1))
    per = df.groupBy(*sk).agg(F.max(dc).alias("_last"), days_of.alias("_n"),
                              F.max_by(investors, dc).alias("_inv"), F.max_by(value, dc).alias("_val"))
    keep = per.where((F.col("_last") == per.agg(F.max("_last")).scalar()) & (F.col("_n") > days))
    if base:
        w_fund = Window.partitionBy(fund)
        keep = (keep.withColumn("_max_inv", F.max("_inv").over(w_fund))
                .withColumn("_inv_nulls", F.sum(F.col("_inv").isNull().cast("int")).over(w_fund))
                .where((F.col("_inv_nulls") == 0) & (F.col("_inv") == F.col("_max_inv")) & (F.col("_inv") > 0)))
        w_top = Window.partitionBy(fund).orderBy(F.col("_val").desc(), F.col(part))
        keep = (keep.withColumn("_val_nulls", F.sum(F.col("_val").isNull().cast("int")).over(w_fund))
                .withColumn("_rn", F.row_number().over(w_top))
                .where((F.col("_val_nulls") == 0) & (F.col("_rn") == 1)))
    return semi(df, keep.select(*sk), sk)


def long_series(df: DataFrame, days: int = 365, sk: Sequence[str] = SERIES) -> DataFrame:
    """Series with more than ``days`` rows, strictly."""
    keep = df.groupBy(*sk).count().where(F.col("count") > days).select(*sk)
    return semi(df, keep, sk)


def base_share_class(df: DataFrame, dc: str = DATE, fund: str = "cod",
                     part: str = "tipo_participacion", investors: str = "numero_inversionistas",
                     value: str = "valor_fondo_cierre_dia_t") -> DataFrame:
    """Per fund, the participation with most investors on the last day.

    Ties on investors go to the largest closing value, then to the first
    participation. A fund with zero investors in its top participation, or
    any NULL investor count on the last day (the source's NA-propagating
    ``max``), has no base. Its whole history is kept.
    """
    last = filter_latest_date(df, dc).select(fund, part, investors, value)
    w_fund = Window.partitionBy(fund)
    top = (last.withColumn("_max_inv", F.max(investors).over(w_fund))
           .withColumn("_inv_nulls", F.sum(F.col(investors).isNull().cast("int")).over(w_fund))
           .where((F.col("_inv_nulls") == 0) & (F.col(investors) == F.col("_max_inv"))
                  & (F.col(investors) > 0)))
    w_top = Window.partitionBy(fund).orderBy(F.col(value).desc(), F.col(part).asc_nulls_last())
    base = (top.withColumn("_val_nulls", F.sum(F.col(value).isNull().cast("int")).over(w_fund))
            .withColumn("_rn", F.row_number().over(w_top))
            .where((F.col("_val_nulls") == 0) & (F.col("_rn") == 1))
            .select(fund, part))
    return semi(df, base, [fund, part])


def filter_recent_calendar(df: DataFrame, since: _dt.date, dc: str = DATE) -> DataFrame:
    """Rows on or after a calendar cut."""
    return df.where(F.col(dc) >= F.lit(since))


def filter_exclude_period(df: DataFrame, start: str | _dt.date = "2020-03-01",
                          end: str | _dt.date = "2020-04-01", dc: str = DATE) -> DataFrame:
    """Drop a shock interval: keep ``d <= start OR d >= end`` (C4)."""
    s = F.lit(start).cast("date")
    e = F.lit(end).cast("date")
    return df.where((F.col(dc) <= s) | (F.col(dc) >= e))


def moving_funds(df: DataFrame, since: _dt.date, min_share: float = 0.5, fund: str = "cod",
                 dc: str = DATE, flow: str = "transaccciones_netas",
                 value: str = "crecimiento_dia") -> DataFrame:
    """Funds whose net flow moves on at least ``min_share`` of their days.

    Only funds with the full history length (``n == max(n)`` over the kept
    funds) stay; the result is ``(fecha_corte, cod, value)`` without NULLs.
    """
    recent = df.where(F.col(dc) >= F.lit(since))
    stats = recent.groupBy(fund).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(F.col(flow) != 0, 1).otherwise(0)).alias("_mov"),
        F.count(F.col(flow)).alias("_flow_n"),
    )
    # a NULL flow makes the share NA in the source, and the fund drops out
    stats = stats.where((F.col("_flow_n") == F.col("_n")) & (F.col("_mov") / F.col("_n") >= min_share))
    keep = stats.where(F.col("_n") == stats.agg(F.max("_n")).scalar()).select(fund)
    return (semi(recent, keep, fund).select(dc, fund, value)
            .dropna(subset=[dc, fund, value]))


def representative_fund(df: DataFrame, value: str = "rent_30", fund: str = "cod",
                        entity: str = "nombre_entidad") -> DataFrame:
    """Per entity, the fund whose median is closest to the entity median.

    Fund median of ``value``; min over (entity, fund); entity median of
    those; keep the least distance, then the highest median (ties kept).
    A NULL anywhere in an entity's inputs drops the entity (NA propagation).
    """
    from fundlens.operators.stats import grouped_min_median

    w = Window.partitionBy(entity)
    scored = (grouped_min_median(df, entity, fund, value)
              .withColumn("cercania", F.abs(F.col("mediana") - F.col("mediana_emp"))))
    closest = scored.withColumn("_min", F.min("cercania").over(w)).where(F.col("cercania") == F.col("_min"))
    best = closest.withColumn("_max", F.max("mediana").over(w)).where(F.col("mediana") == F.col("_max"))
    return best.select(entity, fund, "mediana", "mediana_emp", "cercania")


def cluster_peers(labels: DataFrame, fund_code: str, exclude: Sequence[str] = (),
                  fund: str = "cod", label: str = "cluster") -> DataFrame:
    """Members of the cluster that holds ``fund_code``, minus ``exclude``."""
    target = labels.where(F.col(fund) == fund_code).select(label)
    peers = semi(labels, target, label)
    if exclude:
        peers = peers.where(~F.col(fund).isin(*exclude))
    return peers


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key under a total order (G3); planned as a group limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def extreme_per_group(df: DataFrame, keys: Sequence[str], col: str, largest: bool = True) -> DataFrame:
    """Rows equal to the group max (or min), ties kept."""
    ext = (F.max if largest else F.min)(col).over(Window.partitionBy(*keys))
    return df.withColumn("_ext", ext).where(F.col(col) == F.col("_ext")).drop("_ext")


def best_config(scores: DataFrame, score: str = "silhouette", key: str = "n") -> DataFrame:
    """Best score, ties to the largest id (G5): a global top-1."""
    return scores.orderBy(F.col(score).desc_nulls_last(), F.col(key).desc()).limit(1)
