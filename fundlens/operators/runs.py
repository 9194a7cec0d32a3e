"""The fund panel as runs (F2-F6 and F7-F10 without padded days).

A *run* is an observed row and the ``dias`` calendar days it stands for: its
own day and the days without a report up to the next observation. On those,
balances are carried, flows are 0 and the growth is 0 (NULL while no closing
value is known yet), so nothing about them has to be stored: a series of 20
observations in a year is 20 rows, not 365.

* ``run_panel`` merges the sources, carries, fills and derives the growth on
  observed rows only; ``expand_days`` lists the days (= ``clean_panel``).
* ``rolling_runs`` evaluates trailing windows of calendar days for several
  periods. Their values change only where an observation enters or leaves a
  window, or a window becomes full, so they are computed at those days: one
  window operator, hence one sort, for all periods; its range frames hold the
  observations of a window and nothing else. An observation takes part only in
  windows that contain it; the zeros of the other days enter the spread in
  closed form.
* ``rolling_days`` lists the days with all columns of the panel and the windows'
  values.
* ``last_day_stats`` are the same statistics on each series' last day alone,
  one aggregate.
"""

from __future__ import annotations

import datetime as _dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlens.operators.panel import CARRY, DATE, PANEL_ORDER, SERIES, daily_growth, fill_flows, merge_sources, series_window
from fundlens.operators.rolling import multi_period_risk

DAYS_PER_YEAR = 365
DAYS = "dias"


def run_panel(facts: DataFrame, report: DataFrame | None = None, as_of: _dt.date | None = None,
              sk: Sequence[str] = SERIES, dc: str = DATE, partitions: int | None = None) -> DataFrame:
    """Observed rows of the cleaned panel with the days that each stands for; in ``partitions`` by series, if given."""
    if report is None:
        rows = facts.repartition(partitions, *sk) if partitions else facts
    else:
        rows = merge_sources(facts, report, as_of, partitions=partitions)
    w = series_window(sk, dc)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({**{c: F.last(c, ignorenulls=True).over(so_far) for c in CARRY},
                             DAYS: F.greatest(F.coalesce(F.date_diff(F.lead(dc).over(w), dc), F.lit(1)), F.lit(1))})
    return daily_growth(fill_flows(rows)).select(*PANEL_ORDER, DAYS)


def _silent(closing: Column) -> Column:
    """Growth of a day without a report: 0, or NULL while the closing value is unknown."""
    return F.when(closing.isNotNull(), F.lit(0.0))


def expand_days(runs: DataFrame, dc: str = DATE, start: Column | None = None) -> DataFrame:
    """One row per calendar day of each run (F2-F5), or of its ``dias`` days from ``start`` on."""
    start = F.col(dc) if start is None else start
    day = F.explode(F.sequence(start, F.date_add(start, F.col(DAYS) - 1)))
    rows = runs.withColumn("_day", day)
    added = F.col("_day") != F.col(dc)
    filled = {"rendimientos_abonados": F.lit(0.0), "transaccciones_netas": F.lit(0.0),
              "precierre_fondo_dia_t": F.round("valor_fondo_cierre_dia_t", 1),
              "crecimiento_dia": _silent(F.col("valor_fondo_cierre_dia_t"))}
    rows = rows.withColumns({c: F.when(added, v).otherwise(F.col(c)) for c, v in filled.items()} | {dc: F.col("_day")})
    return rows.select(*[c for c in runs.columns if c != DAYS])


def rolling_runs(runs: DataFrame, periods: Sequence[int] = (30, 365), col: str = "crecimiento_dia",
                 closing: str = "valor_fondo_cierre_dia_t", sk: Sequence[str] = SERIES, dc: str = DATE, keep: Sequence[str] = ()) -> DataFrame:
    """``(series, date, dias, <col>, silent, rent_p..., vol_p...)``: stretches of days with constant return and
    volatility of every period (F10); ``<col>`` is the growth of the first day, ``silent`` that of the others.

    A window that does not hold ``p`` days, or holds a NULL growth, gives NULL. With ``keep`` the stretches are
    ``(series, run, shift, dias, rent_p..., vol_p...)``: the columns ``keep`` of the run that a stretch is part of, and the
    days from the run's first to the stretch's."""
    periods = list(dict.fromkeys(periods))
    day = F.unix_date(F.col(dc))
    series = Window.partitionBy(*sk)
    x = runs.select(*sk, day.alias("_d"), F.col(DAYS).alias("_n"), F.col(col).cast("double").alias("_g"), F.col(closing).isNull().alias("_z"),
                    *[F.col(c).alias(f"_k_{c}") for c in keep])
    x = x.withColumns({"_first": F.min("_d").over(series), "_last": F.max(F.col("_d") + F.col("_n") - 1).over(series)})
    end = F.col("_d") + F.col("_n") - 1
    # the last NULL day that a run brings, known from the run's first NULL day on
    empty = F.lit(None)
    null_end = F.when(F.col("_z") & (F.col("_n") > 1), end).when(F.col("_g").isNull(), F.col("_d"))
    at_once = F.when(F.col("_g").isNull() | ~F.col("_z") | (F.col("_n") < 2), null_end)

    def event(at: Column, seen: bool = False, until: Column | None = None) -> Column:
        return F.struct(at.cast("int").alias("d"), (F.col("_g") if seen else empty.cast("double")).alias("g"), F.lit(seen).alias("seen"),
                        (F.col("_z") if seen else empty.cast("boolean")).alias("z"), (until if until is not None else empty).cast("int").alias("null_end"),
                        *[(F.col(f"_k_{c}") if seen else F.when(F.lit(False), F.col(f"_k_{c}"))).alias(f"k_{c}") for c in keep])

    events = [event(F.col("_d"), True, at_once), event(F.when(F.col("_z") & (F.col("_n") > 1), F.col("_d") + 1), until=null_end)]
    for p in periods:
        events += [event(F.col("_d") + p), event(F.when(F.col("_z") & (F.col("_n") > 1), end + p)),
                   event(F.when(F.col("_d") == F.col("_first"), F.col("_d") + p - 1))]
    e = x.select(*sk, "_first", "_last", F.explode(F.array(*events)).alias("e")).where(F.col("e.d") <= F.col("_last"))
    e = e.groupBy(*sk, F.col("e.d").alias("_d")).agg(
        F.max("_first").alias("_first"), F.max("_last").alias("_last"), F.max("e.g").alias("_g"), F.max("e.seen").alias("_seen"),
        F.max("e.z").alias("_z"), F.max("e.null_end").alias("_null_end"), *[F.max(f"e.k_{c}").alias(f"_k_{c}") for c in keep])
    order = Window.partitionBy(*sk).orderBy("_d")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = {"_next": F.lead("_d").over(order), "_zz": F.last("_z", ignorenulls=True).over(so_far), "_null": F.max("_null_end").over(so_far)}
    if keep:
        cols["run"] = F.last(F.when(F.col("_seen"), F.struct(F.col("_d").alias("_at"), *[F.col(f"_k_{c}").alias(c) for c in keep])), ignorenulls=True).over(so_far)
    for p in periods:
        frame = order.rangeBetween(-(p - 1), Window.currentRow)
        cols |= {f"_m{p}": F.count("_g").over(frame), f"_p{p}": F.product(1 + F.col("_g")).over(frame),
                 f"_a{p}": F.avg("_g").over(frame), f"_v{p}": F.var_pop("_g").over(frame)}
    e = e.withColumns(cols)
    out = {}
    for p in periods:
        full = (F.col("_d") - F.col("_first") + 1 >= p) & (F.col("_null").isNull() | (F.col("_d") - F.least("_null", "_d") >= p))
        out[f"rent_{p}"] = F.when(full, F.pow(F.coalesce(f"_p{p}", F.lit(1.0)), F.lit(DAYS_PER_YEAR / p)) - 1)
    for p in periods:
        full = (F.col("_d") - F.col("_first") + 1 >= p) & (F.col("_null").isNull() | (F.col("_d") - F.least("_null", "_d") >= p))
        out[f"vol_{p}"] = F.when(full, _spread(F.col(f"_m{p}"), F.col(f"_a{p}"), F.col(f"_v{p}"), p))
    length = (F.coalesce(F.col("_next"), F.col("_last") + 1) - F.col("_d")).alias(DAYS)
    if keep:
        return e.select(*sk, "run", (F.col("_d") - F.col("run._at")).alias("shift"), length, *[v.alias(k) for k, v in out.items()])
    silent = F.when(~F.col("_zz"), F.lit(0.0))
    return e.select(*sk, F.date_from_unix_date("_d").alias(dc), length,
                    F.when(F.col("_seen"), F.col("_g")).otherwise(silent).alias(col), silent.alias("silent"), *[v.alias(k) for k, v in out.items()])


def _spread(m: Column, mean: Column, var: Column, p: int) -> Column:
    """Annualised sample deviation of ``m`` values and ``p - m`` zeros; NULL for one day."""
    if p < 2:
        return F.lit(None).cast("double")
    squares = F.when(m > 0, var * m + mean * mean * (m * (p - m) / p)).otherwise(F.lit(0.0))
    return F.sqrt(squares / (p - 1)) * F.lit(math.sqrt(DAYS_PER_YEAR))


def list_days(stretches: DataFrame, col: str = "crecimiento_dia", dc: str = DATE) -> DataFrame:
    """The days of ``rolling_runs``' stretches, one row each."""
    rows = stretches.withColumn("_day", F.explode(F.sequence(F.col(dc), F.date_add(dc, F.col(DAYS) - 1))))
    rows = rows.withColumns({col: F.when(F.col("_day") == F.col(dc), F.col(col)).otherwise(F.col("silent")), dc: F.col("_day")})
    return rows.drop(DAYS, "silent", "_day")


def rolling_days(runs: DataFrame, periods: Sequence[int] = (30, 365), full: bool = False, sk: Sequence[str] = SERIES, dc: str = DATE) -> DataFrame:
    """The panel's days with return and volatility of every period: ``multi_period_risk`` of the listed days, without
    sorting these. ``full`` leaves out, before they are listed, the days on which one of the values is NULL.

    Windows of days are windows of rows where a series has a row a day; a series in which a day comes twice is listed
    first."""
    periods = list(dict.fromkeys(periods))
    panel = [c for c in runs.columns if c != DAYS]
    keep = [c for c in panel if c not in sk]
    stats = [f"{kind}_{p}" for kind in ("rent", "vol") for p in periods]
    again = F.coalesce(F.lead(dc).over(series_window(sk, dc)) == F.col(dc), F.lit(False))
    runs = runs.withColumn("_again", again).withColumn("_again", F.max("_again").over(Window.partitionBy(*sk)))
    once, twice = (runs.where(F.col("_again") == x).drop("_again") for x in (False, True))
    stretches, listed = rolling_runs(once, periods, sk=sk, dc=dc, keep=keep), multi_period_risk(expand_days(twice, dc), periods, sk=sk, dc=dc)
    if full:
        stretches, listed = stretches.dropna(subset=stats), listed.dropna(subset=stats)
    rows = stretches.select(*[F.col(c) if c in sk else F.col(f"run.{c}").alias(c) for c in panel], *stats, "shift", DAYS)
    return expand_days(rows, dc, F.date_add(dc, F.col("shift"))).select(*panel, *stats).unionByName(listed)


def last_day_stats(runs: DataFrame, periods: Sequence[int], col: str = "crecimiento_dia", closing: str = "valor_fondo_cierre_dia_t",
                   sk: Sequence[str] = SERIES, dc: str = DATE) -> DataFrame:
    """``(series, rent_p, vol_p, ...)`` on each series' last day: one window maximum and one aggregate."""
    series = Window.partitionBy(*sk)
    x = runs.withColumns({"_end": F.max(F.date_add(dc, F.col(DAYS) - 1)).over(series), "_total": F.sum(DAYS).over(series)})
    x = x.withColumn("_age", F.date_diff("_end", dc))                      # 0 on the last day
    aggs = []
    for p in periods:
        inside = F.col("_age") < p
        # NULL days in the window: the observed day, or days behind it that the window reaches
        nulls = F.count_if((inside & F.col(col).isNull()) | (F.col(closing).isNull() & (F.col(DAYS) > 1) & (F.col("_age") - F.col(DAYS) + 1 < p)))
        full = (F.max("_total") >= p) & (nulls == 0)
        g = F.when(inside, F.col(col).cast("double"))
        gross = F.coalesce(F.product(1 + g), F.lit(1.0))
        aggs += [F.when(full, F.pow(gross, F.lit(DAYS_PER_YEAR / p)) - 1).alias(f"rent_{p}"),
                 F.when(full, _spread(F.count(g), F.avg(g), F.var_pop(g), p)).alias(f"vol_{p}")]
    return x.groupBy(*sk).agg(*aggs)
