"""Joins between panels and prediction tables.

Both sides are aggregated to one row per key and day before they meet, so a
join never multiplies rows and no key is hotter than its number of days.  A null
key is a key like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from daygrid.operators.blocks import join_keys


def left_by_day(target: DataFrame, measures: DataFrame, keys: Sequence[str], time: str = "day") -> DataFrame:
    """Target rows with their measures, null where there are none."""
    return join_keys(target, measures, keys, [time], "left")


def inner_by_day(target: DataFrame, measures: DataFrame, keys: Sequence[str], time: str = "day") -> DataFrame:
    return join_keys(target, measures, keys, [time])


def inner_by_month(left: DataFrame, right: DataFrame, keys: Sequence[str], month: str = "month") -> DataFrame:
    """Monthly tables; the optimizer broadcasts a side when its size allows."""
    return join_keys(left, right, keys, [month])


def models_side_by_side(preds: DataFrame, models: Sequence[str], keys: Sequence[str] = (),
                        by: Sequence[str] = ()) -> DataFrame:
    """One row per target date present for every model: the truth and a column per model.

    The first model's truth is the canonical one.  A conditional aggregate
    does the pivot in one pass instead of one join per model.
    """
    one = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    wide = preds.where(F.col("model").isin(list(models))).groupBy(*keys, *by, "target").agg(
        one(models[0], "y_real").alias("y_real"), *[one(m, "y_pred").alias(m) for m in models])
    return wide.dropna(subset=list(models))


def left_align(first: DataFrame, others: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Reindex the other tables to the first one's rows, then drop rows with a gap in another column than ``on``."""
    out = first
    for other in others:
        out = join_keys(out, other, on, how="left")
    return out.dropna(subset=[c for c in out.columns if c not in on])


def at_offset(df: DataFrame, keys: Sequence[str], time: str, value: str, horizon: int,
              start=None, end=None) -> DataFrame:
    """Pairs ``y[t]`` (as y_pred) with ``y[t+h]`` (as y_real) by date, not by row."""
    targets = df.select(*keys, F.col(time).alias("target"), F.col(value).alias("y_real"),
                        F.date_sub(time, horizon).alias("origin"))
    if start is not None:
        targets = targets.where(F.col("target") >= F.lit(str(start)).cast("date"))
    if end is not None:
        targets = targets.where(F.col("target") <= F.lit(str(end)).cast("date"))
    origins = df.select(*keys, F.col(time).alias("origin"), F.col(value).alias("y_pred"))
    return join_keys(targets, origins, keys, ["origin"])


def missing_offsets(df: DataFrame, keys: Sequence[str], time: str, horizon: int, start, end) -> DataFrame:
    """Dates of the window, or their origins, that a series does not have."""
    have = df.select(*keys, time)
    window = F.sequence(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))
    base = have.select(*keys).distinct() if keys else have.sparkSession.range(1).select()
    targets = base.select(*keys, F.explode(window).alias(time))
    origins = targets.select(*keys, F.date_sub(time, horizon).alias(time))
    every = targets.union(origins).distinct()
    return join_keys(every, have, keys, [time], "left_anti")


def actuals_with_predictions(preds: DataFrame, models: Sequence[str], keys: Sequence[str] = (),
                             by: Sequence[str] = ("horizon",)) -> DataFrame:
    """Truth (one per date) beside one column per model; a model's gaps stay null."""
    of_model = [F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(m) for m in models]
    return preds.groupBy(*keys, *by, "target").agg(F.min("y_real").alias("y_real"), *of_model)
