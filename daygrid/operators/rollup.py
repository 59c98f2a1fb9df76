"""Aggregation to days, weeks, months and years under per-measure rules."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from daygrid.functions.columns import angle, bin_label, bin_step, unit_cos, unit_sin, unit_vector
from daygrid.operators.blocks import join_keys


class Measure(NamedTuple):
    """``name = how(source)``; ``how`` is one of the keys of :data:`RULES`."""

    name: str
    how: str
    source: str


# A sum over only missing readings is missing; the legacy rule makes it zero.
RULES = {
    "sum": F.sum,
    "sum_or_zero": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "count": F.count,
}


def apply_rules(measures: Sequence[Measure]) -> list[Column]:
    return [RULES[m.how](m.source).alias(m.name) for m in measures]


def daily_distinct_count(events: DataFrame, keys: Sequence[str], event_id: str, day: str, name: str = "y") -> DataFrame:
    """Distinct events per day.  After ``dedup_events`` use :func:`daily_count`."""
    return events.groupBy(*keys, day).agg(F.count_distinct(event_id).alias(name))


def daily_count(events: DataFrame, keys: Sequence[str], day: str, name: str = "y") -> DataFrame:
    return events.groupBy(*keys, day).agg(F.count(F.lit(1)).alias(name))


def target_profile(daily: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Events, days, zero days, mean, median and maximum of a daily count."""
    return daily.groupBy(*keys).agg(
        F.sum(value).cast("bigint").alias("events"), F.count(F.lit(1)).alias("days"),
        F.count_if(F.col(value) == 0).alias("zero_days"),
        F.avg(value).alias("daily_mean"), F.max(value).alias("daily_max"),
        # One row per key and day: the calendar bounds what the exact median holds.
        F.percentile(value, F.lit(0.5)).alias("daily_median"))


def daily_measures(
    readings: DataFrame, keys: Sequence[str], day: str, measures: Sequence[Measure],
    direction: str | None = None,
) -> DataFrame:
    """Readings to days.  ``direction`` (degrees) becomes a unit vector and an angle."""
    if direction is None:
        return readings.groupBy(*keys, day).agg(*apply_rules(measures))
    grouped = readings.groupBy(*keys, day).agg(
        *apply_rules(measures),
        F.avg(unit_sin(direction)).alias("_s"), F.avg(unit_cos(direction)).alias("_c"))
    return _with_direction(grouped, "dir_sin", "dir_cos", "dir_angle")


def _with_direction(grouped: DataFrame, sin: str, cos: str, degrees: str | None) -> DataFrame:
    s, c = unit_vector(F.col("_s"), F.col("_c"))
    out = grouped.withColumns({sin: s, cos: c}).drop("_s", "_c")
    return out.withColumn(degrees, angle(F.col(sin), F.col(cos))) if degrees else out


def circular_mean(readings: DataFrame, keys: Sequence[str], degrees: str, name: str = "mean_angle") -> DataFrame:
    """Mean direction in [0, 360) per group, null when the directions cancel out."""
    grouped = readings.groupBy(*keys).agg(
        F.avg(unit_sin(degrees)).alias("_s"), F.avg(unit_cos(degrees)).alias("_c"))
    s, c = unit_vector(F.col("_s"), F.col("_c"))
    return grouped.select(*keys, angle(s, c).alias(name))


def circular_reaggregate(daily: DataFrame, keys: Sequence[str], time: str, freq: str,
                         sin: str = "dir_sin", cos: str = "dir_cos") -> DataFrame:
    """Stored unit vectors to bins: mean, back to length one, angle and number of days."""
    grouped = daily.groupBy(*keys, bin_label(time, freq).alias("bin")).agg(
        F.avg(sin).alias("_s"), F.avg(cos).alias("_c"), F.count(F.lit(1)).alias("days"))
    return _with_direction(grouped, sin, cos, "dir_angle")


def resample(
    daily: DataFrame, keys: Sequence[str], time: str, measures: Sequence[Measure], freq: str,
    direction: tuple[str, str] | None = None, out: str = "bin",
) -> DataFrame:
    """Days to bins.  Empty bins between the first and last day of a series are emitted.

    The bins are the group keys, so the calendar join runs on already
    aggregated rows: one per series and bin.
    """
    extra = [F.avg(direction[0]).alias("_s"), F.avg(direction[1]).alias("_c")] if direction else []
    binned = daily.withColumn(out, bin_label(time, freq))
    grouped = binned.groupBy(*keys, out).agg(*apply_rules(measures), *extra)
    if direction:
        grouped = _with_direction(grouped, *direction, None)
    limits = grouped.groupBy(*keys).agg(F.min(out).alias("_lo"), F.max(out).alias("_hi"))  # from the bins, not the days
    bins = limits.select(*keys, F.explode(F.sequence("_lo", "_hi", bin_step(freq))).alias(out))
    filled = join_keys(bins, grouped, keys, [out], "left")
    zero = {m.name: 0.0 for m in measures if m.how == "sum_or_zero"}
    return filled.fillna(zero) if zero else filled


def resample_legacy(daily: DataFrame, keys: Sequence[str], time: str, sums: Sequence[Measure],
                    means: Sequence[Measure], freq: str, out: str = "bin") -> DataFrame:
    """Older rule: sums of empty bins are zero, then bins with a missing mean are dropped."""
    table = resample(daily, keys, time, [*sums, *means], freq, out=out)
    return table.dropna(subset=[m.name for m in means]) if means else table


def multi_scale(daily: DataFrame, keys: Sequence[str], time: str, measures: Sequence[Measure],
                direction: tuple[str, str] | None = None) -> DataFrame:
    """Day, week (ending Monday) and month rows in one table, told apart by ``scale``."""
    names = [m.name for m in measures] + list(direction or ())
    picked = {m.name: F.col(m.source) for m in measures}
    days = daily.select(*keys, F.col(time).alias("bin"),
                        *[picked.get(n, F.col(n)).alias(n) for n in names])
    frames = [("day", days)] + [
        (scale, resample(daily, keys, time, measures, freq, direction).select(*keys, "bin", *names))
        for scale, freq in (("week", "week_mon"), ("month", "month"))]
    out = None
    for scale, frame in frames:
        part = frame.withColumn("scale", F.lit(scale))
        out = part if out is None else out.unionByName(part)
    return out


def yearly_stats(daily: DataFrame, keys: Sequence[str], time: str, value: str, test_start) -> DataFrame:
    """Mean, sample deviation and days per year; years reaching into the test period are flagged."""
    year = F.year(time).cast("bigint")
    first_test = F.year(F.lit(str(test_start)).cast("date"))
    return (daily.groupBy(*keys, year.alias("year"))
            .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("days"))
            .withColumn("has_test_days", F.col("year") >= first_test))


def period_summary(df: DataFrame, keys: Sequence[str], time: str, value: str | None = None) -> DataFrame:
    aggs = [F.min(time).alias("first_day"), F.max(time).alias("last_day"), F.count(F.lit(1)).alias("n_rows")]
    if value:
        aggs.append(F.avg(value).alias("mean"))
    return df.groupBy(*keys).agg(*aggs)
