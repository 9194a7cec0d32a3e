"""Cross-sectional statistics and series diagnostics (E3, E4, E7, F12, K1-K5,
J1, J2).

All statistics are exact (quantiles interpolate linearly between order
statistics, groups of any size). Lagged products and centred means work on
blocks of a series with borders (``blocks``): no series is one task's work,
and rows are not multiplied by lags.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlens.operators.blocks import lag_sums, positions, with_borders
from fundlens.operators.quantiles import exact_quantiles


def cross_section_median(df: DataFrame, col: str = "crecimiento_dia", dc: str = "fecha_corte",
                         name: str = "mean_creci") -> DataFrame:
    """One value per day: the median over funds (the index, E3)."""
    return exact_quantiles(df, [dc], col, [0.5]).select(dc, F.col("_q")[0].alias(name))


def quantile_band(df: DataFrame, keys: Sequence[str], col: str,
                  qs: Sequence[float] = (0.25, 0.5, 0.75), names: Sequence[str] = ("q1", "q2", "q3")) -> DataFrame:
    """Exact quantiles of ``col`` per group (E4), of groups of any size."""
    agg = exact_quantiles(df, keys, col, qs)
    return agg.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def group_stat_over(df: DataFrame, keys: Sequence[str], stats: dict) -> DataFrame:
    """Group statistics repeated on every row (F12): aggregates over an
    unordered ``partitionBy(keys)`` window (one exchange on the keys)."""
    w = Window.partitionBy(*keys)
    return df.withColumns({name: fn.over(w) for name, fn in stats.items()})


def grouped_min_median(df: DataFrame, outer: str, inner: str, col: str) -> DataFrame:
    """Median of ``col`` per (outer, inner) group and the median of those per
    outer group (E7). A NULL input makes its median NULL, and a NULL median
    makes the outer median NULL (the source's NA propagation)."""
    per = df.groupBy(outer, inner).agg(
        F.when(F.count_if(F.col(col).isNull()) == 0, F.percentile(col, 0.5)).alias("mediana"))
    w = Window.partitionBy(outer)
    emp = F.when(F.count_if(F.col("mediana").isNull()).over(w) == 0, F.percentile("mediana", 0.5).over(w))
    return per.withColumn("mediana_emp", emp)


def acf(df: DataFrame, col: str, lags: Sequence[int], dc: str = "fecha_corte",
        by: Sequence[str] = ()) -> DataFrame:
    """Sample autocorrelation at the given positional lags (K2).

    ``r_k = sum_t (x_t - m)(x_{t+k} - m) / sum_t (x_t - m)^2`` with ``m``
    the series mean. Lagged products are summed inside blocks of the series
    (``blocks``). Without ``by`` the input is one series of one row per day.
    """
    x = positions(df.select(*by, dc, F.col(col).alias("_x")).dropna(subset=["_x"]), dc, by)
    if by:   # per-series means: a grouped aggregate joined on the series key
        x = x.join(x.groupBy(*by).agg(F.avg("_x").alias("_m")), list(by))
    else:    # one series: the mean is a scalar subquery
        x = x.withColumn("_m", x.agg(F.avg("_x")).scalar())
    x = x.withColumn("_d", F.col("_x") - F.col("_m"))
    num = lag_sums(x, {"_num": ("_d", "_d")}, lags, by)
    if by:
        denom = x.groupBy(*by).agg(F.sum(F.col("_d") * F.col("_d")).alias("_den"))
        out = num.join(denom, list(by))
    else:
        out = num.withColumn("_den", x.agg(F.sum(F.col("_d") * F.col("_d"))).scalar())
    return out.select(*by, "lag", F.try_divide(F.col("_num"), F.col("_den")).alias("acf"))


def ccf(df: DataFrame, col: str, others: Sequence[str], lags: Sequence[int],
        dc: str = "fecha_corte") -> DataFrame:
    """Cross-correlation of ``col`` with each of ``others`` (K3).

    ``r_k = (1/n) sum_t (x_{t+k} - mx)(y_t - my) / (sx sy)`` with
    population standard deviations, over rows complete in all columns.
    """
    cols = [col, *others]
    x = positions(df.select(dc, *cols).dropna(), dc)
    # scalar subqueries over the same input (merged into one aggregate by the optimizer)
    facts = {"_n": x.agg(F.count(F.lit(1))).scalar(), **{f"_s_{c}": x.agg(F.stddev_pop(c)).scalar() for c in cols}}
    d = x.withColumns({f"_m_{c}": x.agg(F.avg(c)).scalar() for c in cols})
    d = d.withColumns({f"_d_{c}": F.col(c) - F.col(f"_m_{c}") for c in cols})
    sums = lag_sums(d, {f"_p_{o}": (f"_d_{col}", f"_d_{o}") for o in others}, lags).withColumns(facts)
    wide = sums.select("lag", *[F.try_divide(F.col(f"_p_{o}") / F.col("_n"), F.col(f"_s_{col}") * F.col(f"_s_{o}")).alias(o) for o in others])
    return wide.unpivot("lag", list(others), "variable", "ccf")


def decompose(df: DataFrame, col: str, dc: str = "fecha_corte", period: int = 7, trend: int = 91,
              by: Sequence[str] = ()) -> DataFrame:
    """Observed / trend / season / remainder (K1), moving-average form.

    Trend: centred mean over ``trend`` rows (NULL where the frame is not
    full), in blocks with ``trend // 2`` border rows on either side. Season:
    mean of the detrended value per position modulo ``period``, centred to
    sum zero. Remainder: the rest.
    """
    half = trend // 2
    x = with_borders(positions(df.select(*by, dc, F.col(col).alias("observed")), dc, by), half, half)
    w = Window.partitionBy(*by, "_block").orderBy("_i").rowsBetween(-half, half)
    x = x.withColumn("trend", F.when(F.count("observed").over(w) == 2 * half + 1, F.avg("observed").over(w))).where("_own")
    x = x.withColumn("_phase", (F.col("_i") - 1) % period)
    phase = x.groupBy(*by, "_phase").agg(F.avg(F.col("observed") - F.col("trend")).alias("_s"))
    wp = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))       # ``period`` rows a series
    phase = phase.withColumn("season", F.col("_s") - F.avg("_s").over(wp)).drop("_s")
    # ``period`` rows per series: broadcast only for the single-series case
    out = x.join(phase if by else F.broadcast(phase), [*by, "_phase"], "left")
    out = out.withColumn("remainder", F.col("observed") - F.col("trend") - F.col("season"))
    return out.select(*by, dc, "observed", "trend", "season", "remainder")


# --- fixed values: calendar labels used by the seasonal profile ------------
WEEKDAY_LABELS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTH_LABELS = ["January", "February", "March", "April", "May", "June", "July", "August",
                "September", "October", "November", "December"]
# ---------------------------------------------------------------------------


def seasonal_feature(dc: str, feature: str):
    if feature == "wday.lbl":
        return F.element_at(F.array(*[F.lit(v) for v in WEEKDAY_LABELS]), F.weekday(dc) + 1)
    if feature == "month.lbl":
        return F.element_at(F.array(*[F.lit(v) for v in MONTH_LABELS]), F.month(dc))
    if feature == "year":
        return F.year(dc).cast("string")
    raise ValueError(f"unknown seasonal feature {feature!r}")


def seasonal_profile(df: DataFrame, col: str, feature: str, dc: str = "fecha_corte") -> DataFrame:
    """Distribution of ``col`` per calendar feature (K4): min, quartiles,
    max, mean, count -- the numbers behind a violin plot."""
    g = df.select(seasonal_feature(dc, feature).alias("grupo"), F.col(col).alias("_v")).dropna()
    agg = g.groupBy("grupo").agg(
        F.min("_v").alias("min"), F.percentile("_v", [0.25, 0.5, 0.75]).alias("_q"),
        F.max("_v").alias("max"), F.avg("_v").alias("mean"), F.count(F.lit(1)).alias("n"))
    return agg.select("grupo", "min", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("median"),
                      F.col("_q")[2].alias("q75"), "max", "mean", "n")


def pivot_wide(df: DataFrame, key: str, pivot_col: str, value: str, values: Sequence) -> DataFrame:
    """One row per key, one column per listed value (J1); explicit values
    only, so no job looks for them."""
    return df.groupBy(key).pivot(pivot_col, list(values)).agg(F.first(value))


def pivot_days(df: DataFrame, key: str, value: str, first: _dt.date, days: int, dc: str = "fecha_corte", prefix: str = "d_") -> DataFrame:
    """One row per key, one column per calendar day (J1): ``d_0`` is ``first``, ``d_<n>`` the n-th day after it.
    ``df`` has one row per key and day.

    The days of a key become one array, by a single aggregate; its places
    are found by date, so that a missing day is NULL. The columns are places
    of that array: neither the aggregate nor its code grows with the days."""
    at = F.date_diff(dc, F.lit(first))
    rows = df.where((at >= 0) & (at < days)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col(value).alias("v")))).alias("_p"))
    # fill the gaps: before each entry as many NULLs as days lie between it and the one before
    none = F.lit(None).cast(df.schema[value].dataType)
    gaps = F.transform("_p", lambda x, i: F.concat(
        F.array_repeat(none, F.greatest(x["at"] - F.when(i == 0, F.lit(0)).otherwise(F.col("_p")[i - 1]["at"] + 1), F.lit(0)).cast("int")), F.array(x["v"])))
    dense = rows.select(key, F.flatten(gaps).alias("_v"))
    return dense.select(key, *[F.get("_v", F.lit(i)).alias(f"{prefix}{i}") for i in range(days)])


def unpivot_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "name",
                 value: str = "value") -> DataFrame:
    """Columns -> (name, value) rows."""
    return df.unpivot(list(ids), list(cols), name, value)
