"""Registered model queries: clustering (L1-L6), forecasting (M6-M9) and the
model store (A10). Model outputs have no SQL twin (rows-only checks); their
invariants are asserted in ``tests/test_stats_models.py``."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fundlens.operators import cluster as CL
from fundlens.operators import forecast as FC
from fundlens.operators.rolling import rolling_return_gross
from fundlens.operators.stats import quantile_band
from fundlens.operators.universe import best_config, cluster_peers
from fundlens.plans.queries_stats import GRID_KS, _ds, _model_rows, _moving, parameter_grid
from fundlens.plans.report import forecast_projection, forecast_report
from fundlens.plans.catalog import register

#: Repetitions per base clustering in the registered queries, as in the source: 900 fits for the sweep, in lockstep.
REPS = 100
#: Windows of the backtests and of the holdout bands of all models, as in the source.
FOLDS = 13
K = 5


def _vectors(ctx):
    def build():
        z = FC.standardize(_moving(ctx), ["crecimiento_dia"])
        return CL.fund_vectors(z).checkpoint(eager=True)
    return ctx._cached(("vectors",), build)


def _map(ctx):
    return ctx._cached(("map",), lambda: CL.embed_2d(_vectors(ctx)).checkpoint(eager=True))


def _members(ctx):
    """Base clusterings of every k of the grid, fitted once per session: label arrays and the fits."""
    return ctx._cached(("members",), lambda: CL.member_arrays(_map(ctx), GRID_KS, reps=REPS))


def _sweep(ctx):
    """Scores of all configurations, and the clusters of each fund in all of them."""
    def build():
        scores, clusters = CL.sweep_partitions(_map(ctx), parameter_grid(ctx.spark), members=_members(ctx))
        return scores.checkpoint(eager=True), clusters
    return ctx._cached(("sweep",), build)


register("fund_vectors")(lambda ctx: _vectors(ctx).select("cod", "n", vector_to_array("features").alias("features")))
register("embed_2d")(lambda ctx: _map(ctx).select("cod", "x", "y"))
register("cluster_members")(lambda ctx: CL.long_labels(*_members(ctx), K, CL.ALGORITHMS, REPS))
register("silhouette_sweep")(lambda ctx: _sweep(ctx)[0])


def _clusters(ctx, n):
    """``(cod, cluster)`` of configuration n."""
    return _sweep(ctx)[1].select("cod", F.get("clusters", F.lit(n - 1)).alias("cluster"))


@register("consensus_cluster")
def _consensus_cluster(ctx):
    """The consensus of all algorithms at ``K`` clusters."""
    every = _sweep(ctx)[0].where((F.col("k") == K) & (F.col("algorithms") == "+".join(CL.ALGORITHMS))).first()
    return _clusters(ctx, every["n"])


@register("cluster_assignment")
def _cluster_assignment(ctx):
    """Best configuration of the sweep, its consensus labels, joined back."""
    best = best_config(_sweep(ctx)[0]).first()
    dims = ctx.dims(2).select("cod", "nombre_entidad", "nombre_patrimonio")
    return CL.cluster_assignment(_map(ctx), _clusters(ctx, best["n"]), dims)


def _direct_model(ctx, kind="gbt"):
    def build():
        feats, cols = FC.model_features(_ds(ctx), FC.DIRECT_LAGS)
        feats = feats.checkpoint(eager=True)
        return feats, cols, FC.fit_direct(feats, cols, kind)
    return ctx._cached(("direct", kind), build)


def _forecast_direct(ctx):
    feats, _, model = _direct_model(ctx)
    return FC.predict(model, feats.where(F.col("creci_dia").isNull()))


register("forecast_direct")(_forecast_direct)
register("forecast_recursive")(lambda ctx: FC.forecast_recursive(_ds(ctx)))


def _backtest(ctx):
    return ctx._cached(("backtest",), lambda: FC.backtest(_ds(ctx), FOLDS, kind="linear").checkpoint(eager=True))


register("backtest")(_backtest)


@register("forecast_quantiles")
def _forecast_quantiles(ctx):
    feats, cols, _ = _direct_model(ctx, "linear")
    pred = FC.predict(_direct_model(ctx, "linear")[2], feats.where(F.col("creci_dia").isNull()))
    res = _backtest(ctx).where(F.col("model") == "direct_linear")
    return FC.forecast_quantiles(pred, res)


@register("model_store")
def _model_store(ctx):
    """Save the fitted direct pipeline, load it back, predict the horizon."""
    feats, _, model = _direct_model(ctx, "linear")
    path = ctx.scratch_path("model")
    FC.save_model(model, path)
    loaded = FC.load_model(path)
    return FC.predict(loaded, feats.where(F.col("creci_dia").isNull()))


# ------- the same evaluation and report on fitted models; the keys without "_models" hold the control, which has a SQL twin
def _holdout(ctx):
    """Forecasts of all models over the last 28 days, fitted on the days before."""
    return ctx._cached(("holdout",), lambda: FC.holdout_predictions(_ds(ctx), folds=FOLDS).checkpoint(eager=True))


register("holdout_models")(_holdout)
register("holdout_eval_models")(lambda ctx: FC.holdout_eval(_holdout(ctx), _model_rows(ctx), model="model"))
register("leaderboard_models")(lambda ctx: FC.leaderboard(_holdout(ctx), _model_rows(ctx)).select("model", "rmse", "n", "rank"))


@register("backtest_models")
def _backtest_models(ctx):
    """Backtest of the boosted and the recursive model, ``FOLDS`` windows each."""
    return ctx._cached(("backtest_models",), lambda: FC.backtest(_ds(ctx), FOLDS, kind="gbt").unionByName(
        FC.backtest(_ds(ctx), FOLDS, kind="recursive")).checkpoint(eager=True))


def _report_models(ctx):
    return forecast_report(_model_rows(ctx), _forecast_quantiles(ctx).select("cod", "fecha_corte", "mean", "q25", "q75"))


register("forecast_report_models")(_report_models)
register("forecast_projection_models")(lambda ctx: forecast_projection(_report_models(ctx).repartition(ctx.buckets(), "cod"), ctx.as_of, 30, 12))


def _best_labels(ctx):
    """Fund labels of the best configuration."""
    return _cluster_assignment(ctx).select("cod", "cluster").where(F.col("cluster").isNotNull()).distinct()


@register("cluster_bands")
def _cluster_bands(ctx):
    """Quartiles of the 30-day return per cluster and day, on the consensus labels."""
    rows = rolling_return_gross(ctx.base5().where(F.col("fecha_corte") >= F.lit(ctx.years_back(1))), 30)
    return quantile_band(rows.join(_best_labels(ctx), "cod").dropna(subset=["rent_brut_30"]), ["cluster", "fecha_corte"], "rent_brut_30")


@register("cluster_peers_models")
def _cluster_peers_models(ctx):
    """The funds that share the consensus cluster of the first fund."""
    labels = _best_labels(ctx)
    return cluster_peers(labels, labels.agg(F.min("cod")).first()[0])
