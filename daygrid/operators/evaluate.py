"""Error metrics, comparisons and residual diagnostics on prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from daygrid.functions.columns import VOLUME_BANDS, VOLUME_CUTS, band, band_order
from daygrid.operators.association import acf, chi2_upper_column, linear_fit, ljung_box_statistic
from daygrid.operators.blocks import join_keys
from daygrid.operators.quality import require, target_covers_predictions
from daygrid.operators.ranks import quantiles

# Lags of the Ljung-Box test.
TEST_LAGS = (7, 14)


def error_columns(clip: bool = True) -> tuple[Column, Column, Column]:
    real = F.col("y_real")
    pred = F.greatest(F.lit(0.0), F.col("y_pred")) if clip else F.col("y_pred")
    return real, pred, real - pred


def mape_aggregate(real: Column, error: Column) -> Column:
    """Mean absolute percentage error over the targets that are not zero."""
    return F.avg(F.when(real != 0, F.abs(F.try_divide(error, real)))) * 100


def metric_aggregates(clip: bool = True) -> list[Column]:
    real, _, e = error_columns(clip)
    n = F.count(e)
    r2 = F.when(n > 1, 1 - F.try_divide(F.sum(e * e), F.regr_syy(F.when(e.isNotNull(), real), e)))
    return [n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
            r2.alias("r2"), mape_aggregate(real, e).alias("mape")]


def forecast_metrics(preds: DataFrame, by: Sequence[str] = ("model", "horizon"), clip: bool = True) -> DataFrame:
    """n, MAE, RMSE, R² and MAPE per group in one aggregation; null instead of NaN."""
    complete = preds.where(F.col("y_real").isNotNull() & F.col("y_pred").isNotNull())
    return complete.groupBy(*by).agg(*metric_aggregates(clip))


def metrics_by_split(table: DataFrame, value: str, forecasts: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and n per forecast column and split; rows without a forecast are skipped."""
    entries = F.array(*[F.struct(F.lit(f).alias("model"), F.col(f).cast("double").alias("y_pred")) for f in forecasts])
    long = table.select(*keys, "split", F.col(value).cast("double").alias("y_real"), F.inline(entries))
    e = F.col("y_pred") - F.col("y_real")
    return long.groupBy(*keys, "model", "split").agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(e).alias("n"))


def monthly_metrics(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics per model, horizon and calendar month, with the mean error (real - predicted)."""
    _, _, e = error_columns(clip=False)
    return (preds.withColumn("month", F.trunc("target", "MM"))
            .groupBy(*keys, "model", "horizon", "month")
            .agg(*metric_aggregates(clip=False), F.avg(e).alias("mean_error")))


def band_mae(preds: DataFrame, target: DataFrame, models: Sequence[str], keys: Sequence[str] = (), time: str = "day",
             value: str = "y", cuts=VOLUME_CUTS, labels=VOLUME_BANDS, check: bool = True) -> DataFrame:
    """Days, share and MAE per model by volume band of one canonical target.

    The prediction table's own truth is ignored.
    """
    if check:
        require(target_covers_predictions(preds, target, keys, time), "the target misses predicted dates")
    truth = target.select(*keys, F.col(time).alias("target"), F.col(value).cast("double").alias("_y"))
    listed = preds.where(F.col("model").isin(list(models))).select(*keys, "model", "target", "y_pred")
    joined = (join_keys(listed, truth, keys, ["target"])
              .withColumn("band", band("_y", cuts, labels)).withColumn("_order", band_order("_y", cuts)))
    first = F.col("model") == models[0]
    total = F.sum("_days").over(Window.partitionBy(*keys))  # three band rows per series
    wide = joined.groupBy(*keys, "band", "_order").agg(
        F.count_if(first).alias("_days"),
        *[F.avg(F.when(F.col("model") == m, F.abs(F.col("_y") - F.col("y_pred")))).alias(m) for m in models])
    return (wide.withColumn("_all", total)
            .select(*keys, "band", F.col("_days").alias("days"),
                    (100.0 * F.col("_days") / F.col("_all")).alias("percent"), *models))


def band_quartiles(df: DataFrame, value: str, by_value: str, cuts=VOLUME_CUTS, labels=VOLUME_BANDS) -> DataFrame:
    """Quartiles of a measure within the volume bands of another."""
    rows = df.dropna(subset=[value, by_value]).withColumn("band", band(by_value, cuts, labels))
    return quantiles(rows, ["band"], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})


def best_by_group(metrics: DataFrame, by: Sequence[str], metric: str = "mae", model: str = "model") -> DataFrame:
    """The model with the smallest metric per group, ties to the first name."""
    return (metrics.where(F.col(metric).isNotNull()).groupBy(*by)
            .agg(F.min(F.struct(metric, model)).alias("_best"))
            .select(*by, F.col(f"_best.{model}").alias("best_model"), F.col(f"_best.{metric}").alias(metric)))


def winner_counts(best: DataFrame, by: Sequence[str] = ("horizon",)) -> DataFrame:
    return best.groupBy(*by, "best_model").agg(F.count(F.lit(1)).alias("wins"))


def residual_table(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Real minus predicted, and its size, per model and date."""
    r = F.col("y_real") - F.col("y_pred")
    return preds.select(*keys, "model", "horizon", "target", "y_real", r.alias("residual"), F.abs(r).alias("abs_error"))


def error_trend(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Line of the absolute error against the true value."""
    return linear_fit(residual_table(preds), "y_real", "abs_error", by)


def residual_diagnostics(preds: DataFrame, by: Sequence[str] = ("model", "horizon"), lags: Sequence[int] = (1, 7, 14)) -> DataFrame:
    """Mean, median and sample deviation of the residuals, their acf and Ljung-Box p-values.

    ``by`` must name every column that tells two residuals of one date apart
    (model, horizon, keys): a series has one residual per date.
    """
    by = list(by)
    residuals = preds.select(*by, "target", (F.col("y_real") - F.col("y_pred")).alias("residual"))
    base = residuals.groupBy(*by).agg(
        F.count("residual").alias("n"), F.avg("residual").alias("mean_residual"),
        # One residual per date of the group: the calendar bounds the exact median.
        F.percentile("residual", F.lit(0.5)).alias("median_residual"),
        F.stddev_samp("residual").alias("std_residual"))
    picked = acf(residuals, by, "target", "residual", max(*lags, *TEST_LAGS)).groupBy(*by).agg(
        *[F.max(F.when(F.col("lag") == k, F.col("acf"))).alias(f"acf_{k}") for k in lags],
        *[ljung_box_statistic(k).alias(f"_q{k}") for k in TEST_LAGS])
    tests = {f"ljung_box_p_{k}": chi2_upper_column(f"_q{k}", F.lit(k)) for k in TEST_LAGS}
    return join_keys(base, picked, by).withColumns(tests).drop(*[f"_q{k}" for k in TEST_LAGS])


def pivot_metric(table: DataFrame, rows: Sequence[str], column: str, values: Sequence, metric: str) -> DataFrame:
    """One column per listed value; the list is explicit, so no extra job finds it."""
    return table.groupBy(*rows).pivot(column, list(values)).agg(F.max(metric))
