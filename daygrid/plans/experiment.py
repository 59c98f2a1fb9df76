"""Model comparisons from validation to stored results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from daygrid.operators.association import pearson_with
from daygrid.operators.evaluate import forecast_metrics
from daygrid.operators.forecast import recut_predictions
from daygrid.operators.joins import inner_by_month
from daygrid.operators.models import HORIZONS, direct_forecast
from daygrid.operators.quality import (
    check_experiment, experiment_bounds, prediction_coverage, require, require_complete_results, same_actuals_across_models,
    same_dates_across_models)
from daygrid.operators.rollup import multi_scale
from daygrid.plans.base import ROLLUP
from daygrid.sources.sinks import append_run, expected_predictions
from daygrid.stage import stage

MODELS = ("boosted_trees", "arx", "persistence")


def run_experiment(panel: DataFrame, keys: Sequence[str], time: str, value: str, features: Sequence[str],
                   models: Sequence[str], horizons: Sequence[int], train: tuple[date, date], test: tuple[date, date],
                   params: Mapping[str, float] | None = None, arx_features: Sequence[str] | None = None,
                   folder: str | None = None, run_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Validate, train every (model, horizon), check the results, and return predictions and metrics, both sorted.

    With ``folder`` the run is stored there with its contract.
    """
    check_experiment(models, horizons, train, test, MODELS, HORIZONS)
    require(experiment_bounds(panel, keys, time, value, train, test), "series too short for the experiment")
    preds = stage(direct_forecast(panel, keys, time, value, features, test, train, models, horizons, params, arx_features))
    by = [*keys, "horizon"]
    require(same_dates_across_models(preds, models, by), "models do not predict the same dates")
    require(same_actuals_across_models(preds, by), "models are scored against different truths")
    off = prediction_coverage(preds, models, horizons, *test, train[1], keys)
    require(off.where((F.col("wrong_delta") > 0) | (F.col("n") == 0) | ~F.col("expected")), "predictions missing or of a wrong date")
    metrics = forecast_metrics(preds, [*keys, "model", "horizon"])
    if folder:
        contract = expected_predictions(panel.sparkSession, models, horizons, *test, panel.select(*keys) if keys else None)
        settings = {"models": list(models), "horizons": list(horizons), "train": train, "test": test, "features": list(features), "params": dict(params or {})}
        append_run(preds, metrics, settings, folder, run_id, contract)
    return preds.orderBy("horizon", "model", *keys, "target"), metrics.orderBy(*keys, "horizon", "mae")


def recut_experiment(preds: DataFrame, keys: Sequence[str], models: Sequence[str], horizons: Sequence[int],
                     start, end) -> tuple[DataFrame, DataFrame]:
    """Stored predictions on a new test period, checked for completeness there, and their metrics; nothing is refitted."""
    part = recut_predictions(preds, start, end)
    require_complete_results(part, models, horizons, start, end, keys)
    return part, forecast_metrics(part, [*keys, "model", "horizon"])


def correlation_table(daily: DataFrame, keys: Sequence[str], time: str, variables: Sequence[str],
                      labels: Mapping[str, str], direction: tuple[str, str] | None = None,
                      monthly: tuple[DataFrame, str] | None = None, target: str = "y") -> DataFrame:
    """Pearson r of the target with each variable by scale, plus one monthly second source."""
    scales = multi_scale(daily, keys, time, ROLLUP, direction)
    table = pearson_with(scales, target, variables, [*keys, "scale"])
    if monthly:
        other, name = monthly
        joined = inner_by_month(scales.where("scale = 'month'").select(*keys, F.col("bin").alias("month"), target), other, keys)
        table = table.unionByName(
            pearson_with(joined, target, [name], keys).withColumn("scale", F.lit("month")))
    lookup = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return table.withColumn("label", F.try_element_at(lookup, F.col("variable")))


__all__ = ["MODELS", "correlation_table", "recut_experiment", "run_experiment"]
