"""From raw records to the daily base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from daygrid.functions.columns import any_of
from daygrid.operators.calendar import complete_calendar
from daygrid.operators.joins import left_by_day
from daygrid.operators.quality import Guard, apply_domain_rules, collapse_versions, require
from daygrid.operators.rollup import Measure, daily_count, daily_measures

# How each hourly reading becomes a daily measure.
WEATHER = (
    Measure("temp", "mean", "temp"), Measure("rain", "sum", "rain"),
    Measure("speed_mean", "mean", "wind_speed"), Measure("speed_max", "max", "wind_speed"),
    Measure("gust", "max", "gust"), Measure("n_records", "count", "wind_speed"))
# How each daily measure is rolled up to weeks and months.
ROLLUP = (
    Measure("y", "sum", "y"), Measure("rain", "sum", "rain"), Measure("temp", "mean", "temp"),
    Measure("speed_mean", "mean", "speed_mean"), Measure("speed_max", "max", "speed_max"),
    Measure("gust", "max", "gust"))
READINGS = ("rain", "temp", "wind_dir", "gust", "wind_speed")


def daily_target(events: DataFrame, keys: Sequence[str], start=None, end=None) -> DataFrame:
    """Events (one row each, column ``start``) to a gap-free daily count."""
    counts = daily_count(events.withColumn("day", F.to_date("start")), keys, "day")
    return complete_calendar(counts, keys, "day", fill={"y": 0}, start=start, end=end)


def clean_hourly(hourly: DataFrame, keys: Sequence[str], guard: Guard | None = None) -> DataFrame:
    """Refuse bad keys and conflicting copies, collapse identical ones, null impossible readings.

    One shuffle of the raw rows serves the checks and the result.  With a ``guard``
    they run in the write of the result, without one in a job of their own, at once.
    """
    identity = [*keys, "day", "hour"]
    single = collapse_versions(hourly, identity, READINGS)
    rules = {"null day or hour": any_of([F.col(c).isNull() for c in identity]), "conflicting copies of an hour": F.col("_conflict")}
    if guard:
        single = guard.watch(single, rules, identity)
    else:
        require(single.where(any_of(list(rules.values()))), "null day or hour, or conflicting copies of an hour")
    return apply_domain_rules(single.drop("_conflict"), READINGS, non_negative=("rain", "gust", "wind_speed"),
                              ranges={"wind_dir": (0.0, 360.0)})


def daily_weather(hourly: DataFrame, keys: Sequence[str]) -> DataFrame:
    return daily_measures(hourly, keys, "day", WEATHER, direction="wind_dir")


def daily_base(target: DataFrame, weather: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target days with their weather; both sides already have one row per key and day."""
    return left_by_day(target, weather.drop("dir_angle"), keys)
