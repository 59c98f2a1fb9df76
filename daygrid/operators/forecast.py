"""Baseline forecasts and the long prediction table.

A prediction table has (keys), model, horizon, origin, target, y_real, y_pred.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from daygrid.functions.columns import clip_non_negative
from daygrid.operators.blocks import day_position, join_keys, over_blocks
from daygrid.operators.joins import at_offset
from daygrid.operators.learning import split_by_fraction

COLUMNS = ("model", "horizon", "origin", "target", "y_real", "y_pred")


def prediction_rows(df: DataFrame, keys: Sequence[str], model: str, horizon: int, y_real: str, y_pred: str) -> DataFrame:
    """Cast to the long prediction layout, predictions clipped at zero."""
    return df.select(
        *keys, F.lit(model).alias("model"), F.lit(int(horizon)).alias("horizon"), "origin", "target",
        F.col(y_real).cast("double").alias("y_real"),
        clip_non_negative(F.col(y_pred).cast("double")).alias("y_pred"))


def persistence(df, keys, time, value, horizon: int = 1, start=None, end=None, model: str = "persistence") -> DataFrame:
    """Tomorrow is today: the value at the origin predicts the value h days on."""
    return prediction_rows(at_offset(df, keys, time, value, horizon, start, end), keys, model, horizon,
                           "y_real", "y_pred")


def persistence_suite(df, keys, time, value, scopes: Sequence[tuple[str, int, str, str]]) -> DataFrame:
    """Persistence on several (scope, horizon, first target, last target) in one join."""
    entries = F.array(*[
        F.struct(F.lit(s).alias("scope"), F.lit(int(h)).alias("horizon"),
                 F.lit(str(a)).cast("date").alias("_a"), F.lit(str(b)).cast("date").alias("_b"))
        for s, h, a, b in scopes])
    targets = (df.select(*keys, F.col(time).alias("target"), F.col(value).cast("double").alias("y_real"),
                         F.inline(entries))
               .where(F.col("target").between(F.col("_a"), F.col("_b")))
               .withColumn("origin", F.date_sub("target", F.col("horizon"))))
    origins = df.select(*keys, F.col(time).alias("origin"), F.col(value).cast("double").alias("y_pred"))
    return join_keys(targets, origins, keys, ["origin"]).select(
        *keys, "scope", F.lit("persistence").alias("model"), "horizon", "origin", "target", "y_real", "y_pred")


def moving_average_forecast(df, keys, time, value, window: int = 7, model: str | None = None) -> DataFrame:
    """Mean of the ``window`` days up to yesterday; the first day has no forecast."""
    out = over_blocks(
        df.select(*keys, time, value), keys, day_position(time),
        lambda w: {"_pred": F.avg(value).over(w.rowsBetween(-window, -1))}, back=window)
    dated = out.withColumnsRenamed({time: "target"}).withColumn("origin", F.date_sub("target", 1))
    return prediction_rows(dated, keys, model or f"mean_{window}d", 1, value, "_pred")


def baseline_table(df, keys, time, value, fraction: float = 0.8, window: int = 7) -> DataFrame:
    """Day, split, truth and both baseline forecasts side by side, known up to yesterday."""
    wide = over_blocks(
        df.select(*keys, time, value), keys, day_position(time),
        lambda w: {"persistence": F.lag(F.col(value).cast("double")).over(w),
                   f"mean_{window}d": F.avg(value).over(w.rowsBetween(-window, -1))}, back=window)
    return split_by_fraction(wide, keys, time, fraction)


def recut_predictions(preds: DataFrame, start, end) -> DataFrame:
    """Existing predictions restricted to a new test window; nothing is refitted."""
    return preds.where(F.col("target").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))


def union_model_results(tables: dict[str, DataFrame], day: str = "day", real: str = "real", pred: str = "pred",
                        keys: Sequence[str] = ()) -> DataFrame:
    """Per-model tables (day, real, pred) as one long table with horizon 1 and origin = day - 1."""
    out = None
    for name, table in tables.items():
        part = table.select(
            *keys, F.lit(name).alias("model"), F.lit(1).alias("horizon"), F.date_sub(day, 1).alias("origin"),
            F.col(day).alias("target"), F.col(real).cast("double").alias("y_real"),
            F.col(pred).cast("double").alias("y_pred"))
        out = part if out is None else out.unionByName(part)
    return out
