"""Forecast dataset, splits, features, models and evaluation (F14-F16, M1-M11,
C6, C7, D5, D9, E6, A10, N2).

Data preparation is plain DataFrame work (joins, windows, ``sequence``).
Models are Spark ML estimators fitted on the whole panel (global models,
one row per series-day); the recursive forecaster runs its 28 steps as one
``aggregate`` per series, so no step loops over the driver.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlens.functions.dates import is_weekend
from fundlens.operators import boosting
from fundlens.operators.quantiles import exact_quantiles
from fundlens.sources.landed import holidays, macro_daily, macro_monthly

HORIZON = 28
# --- fixed values: forecast quantile levels and target lags -----------------
QUANTILE_LEVELS = [0.05, 0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95]
TARGET_LAGS = [1, 2, 3, 4, 5, 6, 7, 8, 13, 14, 15, 20, 21, 22, 27, 28, 29, 30, 31, 56, 84,
               363, 364, 365, 727, 728, 729, 1091, 1092, 1093]
# ---------------------------------------------------------------------------


# --- macro covariates (D5) ------------------------------------------------------

BROADCAST_DAYS = 100_000


def _calendar(table: DataFrame) -> DataFrame:
    """The table, broadcast if its size is that of a calendar."""
    few = table.limit(BROADCAST_DAYS + 1).count() <= BROADCAST_DAYS
    return F.broadcast(table) if few else table


def join_macro(df: DataFrame, trm_rows: DataFrame, ipc_rows: DataFrame, holiday_rows: DataFrame,
               dc: str = "fecha_corte") -> DataFrame:
    """Left join the daily rate, the daily-padded monthly index and the
    holiday flag on the date (D5).

    The macro tables have one row per calendar day. They are counted, and
    broadcast up to ``BROADCAST_DAYS`` rows, so that the panel is not moved
    by date; larger ones are left to a shuffle join. Missing holidays are
    FALSE.
    """
    trm = _calendar(macro_daily(trm_rows).withColumnRenamed("fecha", "_d_trm"))
    ipc = _calendar(macro_monthly(ipc_rows).withColumnRenamed("fecha", "_d_ipc"))
    fest = _calendar(holidays(holiday_rows).withColumnRenamed("fecha", "_d_fest"))
    out = (df.join(trm, F.col(dc) == F.col("_d_trm"), "left")
           .join(ipc, F.col(dc) == F.col("_d_ipc"), "left")
           .join(fest, F.col(dc) == F.col("_d_fest"), "left"))
    out = out.withColumn("festivo", F.coalesce(F.col("festivo"), F.lit(False)))
    return out.drop("_d_trm", "_d_ipc", "_d_fest")


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Z-score of columns over the whole frame as it stands.

    Mean and sample sd are scalar subqueries over the frame (the optimizer
    merges them into one aggregate): no unpartitioned window, no join. A
    constant column (sd 0) gives NULL instead of an ANSI division error.
    """
    return df.withColumns({c: F.try_divide(F.col(c) - df.agg(F.avg(c)).scalar(),
                                           df.agg(F.stddev_samp(c)).scalar())
                           for c in cols})


def extend_future(df: DataFrame, horizon: int = HORIZON, key: str = "cod",
                  dc: str = "fecha_corte") -> DataFrame:
    """Append ``horizon`` daily rows after each series' last date.

    Other columns are NULL on the new rows.
    """
    last = df.groupBy(key).agg(F.max(dc).alias("_last"))
    future = last.select(key, F.explode(F.sequence(F.date_add("_last", 1),
                                                    F.date_add("_last", horizon))).alias(dc))
    return df.unionByName(future, allowMissingColumns=True)


def model_dataset(panel: DataFrame, trm_rows: DataFrame, ipc_rows: DataFrame, holiday_rows: DataFrame,
                  horizon: int = HORIZON, key: str = "cod", dc: str = "fecha_corte",
                  value: str = "crecimiento_dia", partitions: int | None = None, write=lambda rows: rows) -> DataFrame:
    """Target + horizon rows + standardised rate and index + non-business
    flag (M1): ``(cod, fecha_corte, creci_dia, trm, ipc, dia_no_habil)``.

    The rate and index are carried forward over days where their tables
    have ended (so the horizon has known covariates). ``write`` may store the
    rows, in ``partitions`` by fund, before they are standardised.
    """
    base = panel.select(key, dc, F.col(value).alias("creci_dia"))
    ext = extend_future(base, horizon, key, dc)
    if partitions:
        ext = ext.repartition(partitions, key)
    j = join_macro(ext, trm_rows, ipc_rows, holiday_rows, dc)
    w = Window.partitionBy(key).orderBy(dc).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = j.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("trm", "ipc")})
    j = j.withColumn("dia_no_habil", (F.col("festivo") | is_weekend(F.col(dc))).cast("double"))
    return standardize(write(j.select(key, dc, "creci_dia", "trm", "ipc", "dia_no_habil")), ["trm", "ipc"])


def null_split(ds: DataFrame, target: str = "creci_dia") -> tuple[DataFrame, DataFrame]:
    """Future rows (target NULL) and model rows (target present)."""
    return ds.where(F.col(target).isNull()), ds.where(F.col(target).isNotNull())


def quality_nulls(df: DataFrame) -> DataFrame:
    """One row: NULL count per column and whether any NULL exists."""
    counts = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in df.columns]
    out = df.agg(*counts)
    return out.withColumn("any_null", F.greatest(*[F.col(f"nulls_{c}") for c in df.columns]) > 0)


def holdout_split(df: DataFrame, days: int = HORIZON, dc: str = "fecha_corte") -> tuple[DataFrame, DataFrame]:
    """Last ``days`` distinct dates = test, the rest = train.

    The cutoff is the ``days``-th largest distinct date: a distinct + top-k
    over dates (one row per calendar day), joined back as a scalar.
    """
    cut = df.select(dc).distinct().orderBy(F.col(dc).desc()).limit(days).agg(F.min(dc)).scalar()
    return df.where(F.col(dc) < cut), df.where(F.col(dc) >= cut)


def cv_plan(df: DataFrame, assess: int = HORIZON, skip: int = HORIZON, max_folds: int = 13,
            dc: str = "fecha_corte", key: str | None = "cod") -> DataFrame:
    """Expanding-window folds, newest first (F16).

    Fold ``k`` (1 = newest) assesses the ``assess`` days ending
    ``(k-1) * skip`` days before the last date; training is every earlier
    day (cumulative). Output long ``(fold, key, date, role)``.
    """
    bounds = fold_bounds(df, max_folds, assess, skip, dc)   # one small min/max action
    keys = [key] if key else []
    folds = F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(s).alias("_a_start"), F.lit(e).alias("_a_end"))
                      for k, s, e in bounds])
    rows = df.select(*keys, dc, F.explode(folds).alias("_f")).select(*keys, dc, "_f.*")
    rows = rows.where(F.col(dc) <= F.col("_a_end")).withColumn(
        "role", F.when(F.col(dc) >= F.col("_a_start"), F.lit("assessment")).otherwise(F.lit("analysis")))
    return rows.select("fold", *keys, dc, "role")


# --- features (M2-M5) --------------------------------------------------------------

def calendar_features(df: DataFrame, dc: str = "fecha_corte") -> DataFrame:
    """Day of week / month / year of each row, horizon rows included (M2)."""
    return df.withColumns({"day_of_week": F.weekday(dc), "day_of_month": F.dayofmonth(dc),
                           "day_of_year": F.dayofyear(dc)})


def lag_features(df: DataFrame, col: str = "creci_dia", lags: Sequence[int] = TARGET_LAGS,
                 key: str = "cod", dc: str = "fecha_corte") -> DataFrame:
    """Target lags as columns ``lag_<n>`` over the series window (M3)."""
    w = Window.partitionBy(key).orderBy(dc)
    return df.withColumns({f"lag_{n}": F.lag(col, n).over(w) for n in lags})


def age_observed_features(df: DataFrame, col: str = "creci_dia", key: str = "cod",
                          dc: str = "fecha_corte") -> DataFrame:
    """``log10(2 + age)`` and an observed indicator with 0 imputation (M4)."""
    w = Window.partitionBy(key).orderBy(dc)
    return df.withColumns({
        "age": F.log10(F.lit(2.0) + (F.row_number().over(w) - 1)),
        "observed": F.col(col).isNotNull().cast("double"),
        f"{col}_filled": F.coalesce(F.col(col), F.lit(0.0)),
    })


def mean_scaling(df: DataFrame, col: str = "creci_dia", key: str = "cod") -> DataFrame:
    """Scale each series by its mean absolute value, 1 when that is 0 (M5)."""
    scale = F.avg(F.abs(col)).over(Window.partitionBy(key))
    df = df.withColumn("scale", F.when((scale == 0) | scale.isNull(), F.lit(1.0)).otherwise(scale))
    return df.withColumn(f"{col}_scaled", F.col(col) / F.col("scale"))


def seasonal_naive_future(model_rows: DataFrame, horizon: int = HORIZON, season: int = 7,
                          key: str = "cod", dc: str = "fecha_corte", value: str = "creci_dia") -> DataFrame:
    """Seasonal-naive forecast of the ``horizon`` days after each series'
    last date: the last observed ``season`` days repeated. Output
    ``(cod, fecha_corte, mean)``. Only a fund's last ``season`` days are
    gathered, by fund, so rows that come by fund do not move."""
    rows = model_rows.select(key, dc, F.col(value).alias("_v"), F.max(dc).over(Window.partitionBy(key)).alias("_last"))
    last = rows.where(F.col(dc) > F.date_sub("_last", season)).groupBy(key).agg(
        F.max("_last").alias("_last"), F.collect_list(F.struct(F.col(dc).alias("d"), F.col("_v").alias("v"))).alias("_week"))
    steps = last.select(key, "_week", "_last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_h"))
    steps = steps.select(key, "_week", F.date_add("_last", F.col("_h")).alias(dc),
                         F.date_add("_last", (F.col("_h") - 1) % season - (season - 1)).alias("_src"))
    found = F.transform(F.filter("_week", lambda x: x["d"] == F.col("_src")), lambda x: x["v"])
    return steps.select(key, dc, F.explode_outer(found).alias("mean"))


def naive_residuals(model_rows: DataFrame, start: _dt.date, folds: int = 13, horizon: int = HORIZON, season: int = 7,
                    key: str = "cod", dc: str = "fecha_corte", value: str = "creci_dia") -> DataFrame:
    """Errors ``(actual, mean)`` of the seasonal-naive control on the
    ``folds`` windows of ``horizon`` days before ``start``; each window only
    uses days before itself."""
    origin = F.date_add(F.lit(start), (-horizon * F.ceil(F.datediff(F.lit(start), F.col(dc)) / horizon)).cast("int"))
    rows = model_rows.where((F.col(dc) < F.lit(start)) & (F.col(dc) >= F.lit(start - _dt.timedelta(horizon * folds))))
    seen = model_rows.where((F.col(dc) < F.lit(start)) & (F.col(dc) >= F.lit(start - _dt.timedelta(horizon * folds + season))))
    return _from_origin(rows.withColumn("_origin", origin), seen, season, key, dc, value).select(
        F.col(value).alias("actual"), "mean")


def residual_bands(pred: DataFrame, residuals: DataFrame) -> DataFrame:
    """Interval bands q05 / q25 / q75 / q95 around a point forecast: the
    percentiles of ``actual - mean`` of earlier forecasts, added to the mean."""
    levels = {"q05": 0.05, "q25": 0.25, "q75": 0.75, "q95": 0.95}
    errors = residuals.select((F.col("actual") - F.col("mean")).alias("_r"))
    qs = exact_quantiles(errors, [], "_r", list(levels.values())).scalar()
    return pred.withColumns({n: F.col("mean") + F.get(qs, F.lit(i)) for i, n in enumerate(levels)})


# --- evaluation (D9, E6, M10, M11) -----------------------------------------------

def _from_origin(rows: DataFrame, actual: DataFrame, season: int, key: str, dc: str, value: str) -> DataFrame:
    """``rows`` (with ``_origin``) and ``mean``: the last ``season`` days before the origin, repeated."""
    src = F.date_add("_origin", (F.pmod(F.datediff(F.col(dc), F.col("_origin")), F.lit(season)) - season).cast("int"))
    obs = actual.select(key, F.col(dc).alias("_src"), F.col(value).alias("mean"))
    return rows.withColumn("_src", src).join(obs, [key, "_src"], "inner").drop("_src", "_origin")


def seasonal_naive(actual: DataFrame, start: _dt.date, horizon: int = HORIZON, lag: int = 7,
                   key: str = "cod", dc: str = "fecha_corte", value: str = "creci_dia") -> DataFrame:
    """Seasonal-naive control for the ``horizon`` days from ``start`` on: the
    last ``lag`` days before ``start`` repeated. No value on or after
    ``start`` is read."""
    target = actual.select(key, dc).where((F.col(dc) >= F.lit(start)) & (F.col(dc) < F.lit(start + _dt.timedelta(horizon))))
    seen = actual.where((F.col(dc) < F.lit(start)) & (F.col(dc) >= F.lit(start - _dt.timedelta(lag))))
    return _from_origin(target.withColumn("_origin", F.lit(start)), seen, lag, key, dc, value).select(key, dc, "mean")


def rmse(pred: DataFrame, actual: DataFrame, keys: Sequence[str] = ("cod", "fecha_corte"),
         pred_col: str = "mean", value: str = "creci_dia", by: Sequence[str] = ()) -> DataFrame:
    """Root mean squared error of key-aligned predictions."""
    a = actual.select(*keys, F.col(value).alias("_actual"))
    j = pred.join(a, list(keys), "inner")
    return j.groupBy(*by).agg(F.sqrt(F.avg(F.pow(F.col(pred_col) - F.col("_actual"), 2))).alias("rmse"),
                              F.count(F.lit(1)).alias("n"))


def leaderboard(preds: DataFrame, actual: DataFrame, keys: Sequence[str] = ("cod", "fecha_corte"),
                model: str = "model", pred_col: str = "mean", value: str = "creci_dia") -> DataFrame:
    """Models ranked by RMSE against key-aligned actuals."""
    scores = rmse(preds, actual, keys, pred_col, value, by=[model])
    w = Window.orderBy(F.col("rmse").asc_nulls_last(), F.col(model))  # one row per model
    return scores.withColumn("rank", F.rank().over(w))


def holdout_eval(pred: DataFrame, actual: DataFrame, keys: Sequence[str] = ("cod", "fecha_corte"),
                 value: str = "creci_dia", model: str | None = None) -> DataFrame:
    """RMSE and coverage of the 5-95 and 25-75 bands."""
    a = actual.select(*keys, F.col(value).alias("_actual"))
    j = pred.join(a, list(keys), "inner")
    x = F.col("_actual")
    by = [model] if model else []
    return j.groupBy(*by).agg(
        F.sqrt(F.avg(F.pow(F.col("mean") - x, 2))).alias("rmse"),
        F.avg(x.between(F.col("q05"), F.col("q95")).cast("double")).alias("coverage_90"),
        F.avg(x.between(F.col("q25"), F.col("q75")).cast("double")).alias("coverage_50"),
        F.count(F.lit(1)).alias("n"))


# --- models (M6-M9, A10, N2) ---------------------------------------------------------

DIRECT_LAGS = [n for n in TARGET_LAGS if n >= HORIZON]
RECURSIVE_LAGS = [1, 2, 3, 4, 5, 6, 7, 14, 21, 28]
COVARIATES = ["trm", "ipc", "dia_no_habil"]
CALENDAR = ["day_of_week", "day_of_month", "day_of_year"]


def model_features(ds: DataFrame, lags: Sequence[int], key: str = "cod", dc: str = "fecha_corte",
                   target: str = "creci_dia") -> tuple[DataFrame, list[str]]:
    """Lag + calendar + known-covariate columns; missing lags (series start,
    horizon) are 0 with the age feature telling the model how much history
    there is."""
    out = calendar_features(lag_features(ds, target, lags, key, dc), dc)
    out = out.withColumn("age", F.log10(F.lit(2.0) + (F.row_number().over(
        Window.partitionBy(key).orderBy(dc)) - 1)))
    lag_cols = [f"lag_{n}" for n in lags]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in lag_cols + COVARIATES})
    return out, lag_cols + COVARIATES + CALENDAR + ["age"]


def _vector(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols]).alias("x")


def fit_direct(train: DataFrame, feature_cols: Sequence[str], kind: str = "gbt", target: str = "creci_dia"):
    """Global direct model (M6): features only use lags >= horizon, so one
    fitted model serves all 28 steps. ``kind``: ``gbt`` (``boosting``) or ``linear``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = train.where(F.col(target).isNotNull())
    if kind == "gbt":
        data = rows.select(_vector(feature_cols), F.col(target).alias("y"), F.lit(1).alias("b"))
        edges = boosting.feature_edges(data, len(feature_cols))
        return boosting.as_pipeline(boosting.grow_folds(data, 1, edges)[0], feature_cols)
    asm = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="keep")
    reg = LinearRegression(featuresCol="features", labelCol=target, predictionCol="mean",
                           regParam=0.0, solver="normal")
    return Pipeline(stages=[asm, reg]).fit(rows)


def predict(model, rows: DataFrame, key: str = "cod", dc: str = "fecha_corte") -> DataFrame:
    return model.transform(rows).select(key, dc, "mean")


def fit_recursive(train: DataFrame, feature_cols: Sequence[str], target: str = "creci_dia"):
    """One-step global linear model (M7), fitted by Spark ML."""
    return fit_direct(train, feature_cols, kind="linear", target=target)


def forecast_recursive(ds: DataFrame, horizon: int = HORIZON, lags: Sequence[int] = RECURSIVE_LAGS,
                       key: str = "cod", dc: str = "fecha_corte", target: str = "creci_dia") -> DataFrame:
    """Recursive forecast (M7): fit a one-step linear model, then run the
    ``horizon`` steps, each feeding its prediction to the next, as one
    ``aggregate`` over a fund's horizon rows with the recent values as state.

    Everything but the lag terms is known beforehand and summed per row. A
    fund's arrays hold its last ``max(lags)`` days and its horizon.
    """
    feats, cols = model_features(ds, lags, key, dc, target)
    lr = fit_recursive(feats, cols, target).stages[-1]
    weights = F.array(*[F.lit(float(v)) for v in (lr.intercept, *lr.coefficients)])
    hist = ds.where(F.col(target).isNotNull())
    last = hist.groupBy(key).agg(F.max(dc).alias("_last"), F.count(F.lit(1)).alias("_n"))
    recent = hist.join(last, key).where(F.col(dc) > F.date_sub("_last", max(lags)))
    future = ds.where(F.col(target).isNull()).join(last, key).withColumn("_w", weights)
    return _recursive_paths(recent, future, [key], cols, lags, dc, target)


def _recursive_paths(recent: DataFrame, future: DataFrame, by: Sequence[str], cols: Sequence[str], lags: Sequence[int],
                     dc: str, target: str) -> DataFrame:
    """``(by, date, mean)``: the steps of every group of ``future`` rows (with ``_last``, ``_n`` and the weights
    ``_w``: the intercept, then ``cols``), started from its ``recent`` rows; one ``aggregate`` per group."""
    weight = {c: F.col("_w")[i] for i, c in enumerate(cols, 1)}
    known = F.col("_w")[0] + weight["age"] * F.log10(F.lit(2.0) + F.col("_n") + F.datediff(dc, "_last") - 1)
    for c in COVARIATES + CALENDAR:
        known = known + weight[c] * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    steps = calendar_features(future, dc).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.col(dc), known.alias("known")))).alias("_steps"), F.first("_w").alias("_w"))
    past = recent.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(dc, target))).alias("_past"))

    def step(values: Column, row: Column) -> Column:
        y = row["known"]
        for n in lags:
            y = y + weight[f"lag_{n}"] * F.coalesce(F.try_element_at(values, F.lit(-n)), F.lit(0.0))
        return F.concat(values, F.array(y))

    path = F.aggregate("_steps", F.transform("_past", lambda p: p[target].cast("double")), step)
    out = steps.join(past, list(by)).select(*by, "_steps", F.slice(path, F.size("_past") + 1, F.size("_steps")).alias("_y"))
    return out.select(*by, F.explode(F.arrays_zip(F.col("_steps")[dc].alias(dc), F.col("_y").alias("mean"))).alias("_r")).select(
        *by, F.col("_r")[dc].alias(dc), F.col("_r")["mean"].alias("mean"))


def fold_bounds(rows: DataFrame, folds: int = 13, assess: int = HORIZON, skip: int = HORIZON,
                dc: str = "fecha_corte") -> list[tuple[int, _dt.date, _dt.date]]:
    """``(fold, start, end)`` of the assessment windows, newest first (F16)."""
    lo, hi = rows.agg(F.min(dc), F.max(dc)).first()
    out = []
    for k in range(1, folds + 1):
        end = hi - _dt.timedelta(days=(k - 1) * skip)
        start = end - _dt.timedelta(days=assess - 1)
        if start > lo:
            out.append((k, start, end))
    return out


def _fold_of(dc: str, bounds) -> Column:
    """Fold whose assessment window holds the date, else NULL."""
    expr = None
    for k, start, end in bounds:
        cond = (F.col(dc) >= F.lit(start)) & (F.col(dc) <= F.lit(end))
        expr = F.when(cond, F.lit(k)) if expr is None else expr.when(cond, F.lit(k))
    return expr


def _train_bucket(dc: str, bounds) -> Column:
    """Bucket ``b``: the row trains every fold ``k <= b`` (0 = no fold)."""
    expr = None
    for k, start, _ in sorted(bounds, key=lambda b: b[1], reverse=True):
        cond = F.col(dc) >= F.lit(start)
        expr = F.when(cond, F.lit(k - 1)) if expr is None else expr.when(cond, F.lit(k - 1))
    return expr.otherwise(F.lit(len(bounds)))


def _linear_fold_coefficients(feats: DataFrame, cols: Sequence[str], bounds, dc: str, target: str,
                              ridge: float = 1e-9) -> list[tuple[int, list[float]]]:
    """Least-squares coefficients of every expanding fold from ONE pass.

    The normal equations of fold ``k`` are sums over the rows before its
    start, i.e. over the training buckets ``>= k``: one matrix of the products
    of ``1``, ``x`` and ``y`` per bucket, then cumulative sums and a small
    (d+1)^2 solve per fold on the driver.
    """
    import numpy as np

    from fundlens.operators.lockstep import matrix, summed

    d, buckets = len(cols) + 1, len(bounds) + 1

    def products(rb):
        x, b = matrix(rb.column(0)), rb.column(2).to_numpy()
        z = np.concatenate([np.ones((len(x), 1)), x, rb.column(1).to_numpy()[:, None]], axis=1)
        out = np.zeros((buckets, d + 1, d + 1))
        for k in np.unique(b):
            out[k] = z[b == k].T @ z[b == k]
        return out.ravel()

    rows = feats.where(F.col(target).isNotNull()).select(_vector(cols), F.col(target).cast("double").alias("y"), _train_bucket(dc, bounds).cast("int").alias("b"))
    stats = summed(rows, products, buckets * (d + 1) ** 2).reshape(buckets, d + 1, d + 1)
    out = []
    g_acc = np.zeros((d, d))
    b_acc = np.zeros(d)
    for k in range(len(bounds), 0, -1):      # oldest fold first: buckets accumulate
        g_acc += stats[k, :d, :d]
        b_acc += stats[k, :d, d]
        if g_acc[0, 0] <= d:
            continue
        diag = np.diag(g_acc)
        scale = np.where(diag > 0, np.sqrt(np.where(diag > 0, diag, 1.0)), 1.0)  # all-zero column: w = 0
        gs = g_acc / np.outer(scale, scale) + ridge * np.eye(d)
        w = np.linalg.lstsq(gs, b_acc / scale, rcond=None)[0] / scale
        out.append((k, [float(v) for v in w]))
    return out


def backtest(ds: DataFrame, folds: int = 13, horizon: int = HORIZON, kind: str = "linear",
             key: str = "cod", dc: str = "fecha_corte", target: str = "creci_dia", feats: DataFrame | None = None) -> DataFrame:
    """Expanding-window backtest (M9): ``folds`` windows of ``horizon`` days.

    Every fold fits the direct model on the rows before its window and
    predicts the window; the seasonal-naive control (the last observed week
    repeated) predicts the same rows. Output
    ``(model, fold, cod, fecha_corte, h, mean, actual)``.

    ``kind='linear'`` solves all folds from one aggregate pass and predicts
    all windows in one join; ``kind='gbt'`` grows the boosted models of all folds together, a pass per tree level;
    ``kind='recursive'`` fits and runs the one-step model (M7) of all folds in one pass.
    ``feats``: the stored ``model_features`` of the rows, where they are at hand.
    """
    rows = ds.where(F.col(target).isNotNull())
    if kind == "recursive":
        return _backtest_recursive(rows.checkpoint(eager=True), folds, horizon, key, dc, target)
    made, cols = model_features(rows, DIRECT_LAGS, key, dc, target)
    feats = made.checkpoint(eager=True) if feats is None else feats
    bounds = fold_bounds(feats, folds, horizon, horizon, dc)
    starts = {k: s for k, s, _ in bounds}
    spark = ds.sparkSession
    start_df = spark.createDataFrame([(k, s) for k, s in starts.items()], "fold int, _start date")
    test = (feats.withColumn("fold", _fold_of(dc, bounds)).where(F.col("fold").isNotNull())
            .join(F.broadcast(start_df), "fold"))
    test = test.withColumn("h", F.datediff(dc, "_start") + 1)

    if kind == "linear":
        coefs = _linear_fold_coefficients(feats, cols, bounds, dc, target)
        coef_df = spark.createDataFrame(coefs, "fold int, _w array<double>")
        xs = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in cols])
        dot = F.aggregate(F.zip_with(xs, F.col("_w"), lambda x, w: x * w), F.lit(0.0), lambda a, v: a + v)
        direct = test.join(F.broadcast(coef_df), "fold").select(
            F.lit("direct_linear").alias("model"), "fold", key, dc, "h", dot.alias("mean"),
            F.col(target).alias("actual"))
    else:
        data = feats.select(_vector(cols), F.col(target).alias("y"), _train_bucket(dc, bounds).alias("b"))
        # bins from the rows that train every fold: no window is looked into
        edges = boosting.feature_edges(data.where(F.col("b") == data.agg(F.max("b")).scalar()), len(cols))
        models = boosting.grow_folds(data, len(bounds), edges)
        direct = boosting.predict_folds(test.select("fold", key, dc, "h", F.col(target).alias("actual"), _vector(cols)), models)
        direct = direct.select(F.lit(f"direct_{kind}").alias("model"), "fold", key, dc, "h", "mean", "actual")

    # seasonal naive: the last observed week before the window, repeated
    src = test.withColumn("_src", F.date_add("_start", ((F.col("h") - 1) % 7) - 7))
    obs = rows.select(key, F.col(dc).alias("_src"), F.col(target).alias("mean"))
    naive = src.join(obs, [key, "_src"], "left").select(
        F.lit("seasonal_naive").alias("model"), "fold", key, dc, "h", "mean", F.col(target).alias("actual"))
    return direct.unionByName(naive)


def masked(rows: DataFrame, start: _dt.date, horizon: int = HORIZON, dc: str = "fecha_corte",
           target: str = "creci_dia") -> DataFrame:
    """The days before ``start`` and, with a NULL target, the ``horizon`` days from it on."""
    kept = rows.where(F.col(dc) < F.lit(start + _dt.timedelta(horizon)))
    return kept.withColumn(target, F.when(F.col(dc) < F.lit(start), F.col(target)))


def _backtest_recursive(rows: DataFrame, folds: int, horizon: int, key: str, dc: str, target: str) -> DataFrame:
    """All windows in one pass: the coefficients of every fold from one grouped aggregate, the paths of every
    (fund, fold) from another. Equal to ``forecast_recursive`` on the days before each window."""
    spark = rows.sparkSession
    feats, cols = model_features(rows, RECURSIVE_LAGS, key, dc, target)
    feats = feats.checkpoint(eager=True)
    bounds = fold_bounds(rows, folds, horizon, horizon, dc)
    weights = spark.createDataFrame(_linear_fold_coefficients(feats, cols, bounds, dc, target, ridge=1e-13), "fold int, _w array<double>")
    starts = spark.createDataFrame([(k, s) for k, s, _ in bounds], "fold int, _start date")
    # a fund's days before each window: a training bucket counts for the folds up to its number
    buckets = rows.groupBy(key, _train_bucket(dc, bounds).alias("_b")).agg(F.max(dc).alias("_last"), F.count(F.lit(1)).alias("_n")).where("_b > 0")
    seen = (buckets.withColumn("fold", F.explode(F.sequence(F.lit(1), "_b"))).groupBy(key, "fold")
            .agg(F.max("_last").alias("_last"), F.sum("_n").alias("_n")))
    recent = rows.join(seen.select(key, "fold", "_last"), key).where(
        (F.col(dc) <= F.col("_last")) & (F.col(dc) > F.date_sub("_last", max(RECURSIVE_LAGS))))
    test = rows.withColumn("fold", _fold_of(dc, bounds)).where(F.col("fold").isNotNull())
    future = test.join(seen, [key, "fold"]).join(F.broadcast(weights), "fold")
    pred = _recursive_paths(recent, future, [key, "fold"], cols, RECURSIVE_LAGS, dc, target)
    return pred.join(test.select(key, "fold", dc, F.col(target).alias("actual")), [key, "fold", dc]).join(F.broadcast(starts), "fold").select(
        F.lit("recursive_linear").alias("model"), "fold", key, dc, (F.datediff(dc, "_start") + 1).alias("h"), "mean", "actual")


MODELS = ("direct_linear", "direct_gbt", "recursive_linear", "seasonal_naive")


def holdout_predictions(ds: DataFrame, horizon: int = HORIZON, folds: int = 13, key: str = "cod",
                        dc: str = "fecha_corte", target: str = "creci_dia") -> DataFrame:
    """Every model fitted on the days before the last ``horizon`` days and
    forecast over these: ``(model, cod, fecha_corte, mean, q05, q25, q75,
    q95)`` (M11). The bands are percentiles of each model's own errors on
    ``folds`` earlier windows, so nothing on or after the test start is read."""
    rows = ds.where(F.col(target).isNotNull())
    start = rows.select(dc).distinct().orderBy(F.col(dc).desc()).limit(horizon).agg(F.min(dc)).first()[0]
    data = masked(rows, start, horizon, dc, target).checkpoint(eager=True)
    train = data.where(F.col(target).isNotNull())
    feats, cols = model_features(data, DIRECT_LAGS, key, dc, target)
    feats = feats.checkpoint(eager=True)
    window = feats.where(F.col(target).isNull())
    # lags look back only: the features of the days before the window are those without it
    past = feats.where(F.col(target).isNotNull())
    tests = {f"direct_{kind}": backtest(train, folds, horizon, kind, key, dc, target, past) for kind in ("linear", "gbt")}
    tests["recursive_linear"] = backtest(train, folds, horizon, "recursive", key, dc, target)
    tests["seasonal_naive"] = tests["direct_linear"]
    preds = {f"direct_{kind}": predict(fit_direct(feats, cols, kind, target=target), window, key, dc) for kind in ("linear", "gbt")}
    preds["recursive_linear"] = forecast_recursive(data, horizon, key=key, dc=dc, target=target)
    preds["seasonal_naive"] = seasonal_naive(rows, start, horizon, key=key, dc=dc, value=target)
    out = None
    for model in MODELS:
        # their quantiles are found in several passes
        errors = tests[model].where(F.col("model") == model).select("actual", "mean").dropna().checkpoint(eager=True)
        part = residual_bands(preds[model].select(F.lit(model).alias("model"), key, dc, "mean"), errors)
        out = part if out is None else out.unionByName(part)
    return out


def forecast_quantiles(pred: DataFrame, residuals: DataFrame, levels: Sequence[float] = QUANTILE_LEVELS,
                       key: str = "cod", dc: str = "fecha_corte") -> DataFrame:
    """Quantile levels around the mean (M8): the exact percentile of the
    backtest residuals (actual - mean) per horizon step, added to the mean.
    Monotone in the level by construction."""
    res = residuals.select("h", (F.col("actual") - F.col("mean")).alias("_r")).dropna()
    qs = exact_quantiles(res, ["h"], "_r", levels)
    first = pred.groupBy(key).agg(F.min(dc).alias("_first"))
    p = pred.join(first, key).withColumn("h", F.datediff(dc, "_first") + 1).drop("_first")
    out = p.join(F.broadcast(qs), "h", "left")
    names = {lv: f"q{int(round(lv * 100)):02d}" for lv in levels}
    return out.select(key, dc, "h", "mean", *[(F.col("mean") + F.col("_q")[i]).alias(names[lv])
                                             for i, lv in enumerate(levels)])


_CURRENT = "CURRENT"


def _hadoop(spark, path: str):
    """The path's file system and its path class (any store that Spark writes)."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    return new(path).getFileSystem(spark._jsc.hadoopConfiguration()), new


def save_model(model, path: str) -> str:
    """Publish a fitted pipeline as a whole (A10); the new version's folder.

    A version is written to a folder of its own; only then the pointer file
    ``CURRENT`` is replaced, by renaming a complete one over it. A reader never meets a
    half-written model, and a save that fails leaves the published one.
    Earlier versions stay (a reader may be loading one) until ``drop_versions``."""
    import uuid

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    version = f"version-{_dt.datetime.now(_dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    model.write().save(f"{path}/{version}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _hadoop(spark, path)[1](path).toUri(), spark._jsc.hadoopConfiguration())
    fs, new = _hadoop(spark, path)
    draft = new(f"{path}/.{version}")
    out = fs.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    swap = spark.sparkContext._gateway.new_array(options, 1)
    swap[0] = options.OVERWRITE
    context.rename(context.makeQualified(draft), context.makeQualified(new(f"{path}/{_CURRENT}")), swap)
    return f"{path}/{version}"


def current_version(path: str) -> str:
    """Folder of the published version."""
    from pyspark.sql import SparkSession

    text = SparkSession.getActiveSession().read.text(f"{path}/{_CURRENT}", wholetext=True).first()
    return f"{path}/{text[0].strip()}"


def load_model(path: str):
    """The published version of ``save_model``."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(current_version(path))


def drop_versions(path: str) -> list[str]:
    """Delete all versions but the published one; their names."""
    from pyspark.sql import SparkSession

    fs, new = _hadoop(SparkSession.getActiveSession(), path)
    now = current_version(path).rsplit("/", 1)[1]
    old = [s.getPath().getName() for s in fs.listStatus(new(path)) if s.getPath().getName().startswith("version-")]
    old = [name for name in old if name != now]
    for name in old:
        fs.delete(new(f"{path}/{name}"), True)
    return old
