"""The causal feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from daygrid.functions.columns import NO_DIRECTION
from daygrid.operators.blocks import BLOCK
from daygrid.operators.calendar import reindex_calendar
from daygrid.operators.windows import (
    calendar_features, causal_columns, interpolate_linear, renormalise_direction)

# Which columns get which features.
LAG_DAYS = (1, 2, 3, 7)
EMA_SPANS = (3, 7, 14)
STD_WINDOW = 7
SMOOTHED = ("rain", "temp", "gust")
READINGS = ("temp", "rain", "speed_mean", "speed_max", "gust", "dir_sin", "dir_cos")
CALENDAR = ("month", "weekday", "day_of_year", "month_sin", "month_cos")
LINEAR_FEATURES = ("y", "temp", "rain", "gust", "month_sin", "month_cos")


def feature_columns(target: str = "y") -> list[str]:
    """The 41 predictor columns in a fixed order: 8 measures, 5 codes, 16 lags, 9 averages, 3 deviations."""
    return [target, *READINGS, *CALENDAR,
            *[f"{c}_lag_{k}" for c in (target, *SMOOTHED) for k in LAG_DAYS],
            *[f"{c}_ema_{s}" for c in SMOOTHED for s in EMA_SPANS],
            *[f"{c}_std_{STD_WINDOW}d" for c in SMOOTHED]]


def _sound(days: DataFrame, time: str, target: str, readings: Sequence[str]) -> DataFrame:
    """``days`` whose bad rows fail the job that reads them: no pass of their own, and nothing bad is ever written."""
    def refuse(column: str, broken: Column, message: str) -> Column:
        text = F.concat(F.lit(f"{message}; first seen on "), F.coalesce(F.col(time).cast("string"), F.lit("null")))
        return F.when(broken, F.raise_error(text)).otherwise(F.col(column))

    checked = {c: refuse(c, F.col(c).isNull(), f"{c} is missing after interpolation") for c in readings}
    # Within a calendar without gaps, a missing target is the only row that could be dropped from the middle.
    checked[target] = refuse(target, F.col(target).isNull(), f"{target} is missing, the features would have a gap")
    if {"dir_sin", "dir_cos"} <= set(readings):
        opposite = F.col("dir_sin").isNull() | F.col("dir_cos").isNull() | (F.hypot("dir_sin", "dir_cos") < NO_DIRECTION)
        checked["dir_sin"] = refuse("dir_sin", opposite, "direction undefined after interpolation")
    return days.withColumns(checked)


def build_features(base: DataFrame, keys: Sequence[str], time: str = "day", target: str = "y",
                   readings: Sequence[str] = READINGS, size: int = BLOCK) -> DataFrame:
    """Reindex, interpolate readings, add calendar, lags, averages and deviations, drop incomplete rows.

    The target is never interpolated: a day without it is an error, at the ends of
    a series too (cut those days before), and so are a reading no day of a series
    holds and a direction that cancels out.  So only the first rows of a series
    are incomplete, and the result has neither nulls nor gaps.  All ordered
    columns share one exchange.
    """
    smoothed = [c for c in SMOOTHED if c in readings]
    days = reindex_calendar(base.select(*keys, time, target, *readings), keys, time)
    filled = _sound(interpolate_linear(days, keys, time, readings, size=size), time, target, readings)
    whole = calendar_features(renormalise_direction(filled), time)
    table = causal_columns(whole, keys, time, lag=([target, *smoothed], LAG_DAYS), ema=(smoothed, EMA_SPANS),
                           std=(smoothed, STD_WINDOW), size=size)
    return table.dropna(subset=[c for c in table.columns if c not in keys])
