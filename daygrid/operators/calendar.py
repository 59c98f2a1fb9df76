"""Gap-free calendars for panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from daygrid.functions.columns import bin_step
from daygrid.operators.blocks import attach, join_keys, previous_day


def spine(
    df: DataFrame, keys: Sequence[str], time: str, start=None, end=None,
    bounds: str = "global", freq: str = "day",
) -> DataFrame:
    """Every (key, bin) of the calendar.

    Explicit ``start`` / ``end`` win; otherwise the limits are those of the
    whole table (``global``) or of each series (``per_key``).  The limits are
    aggregated on the map side, so a hot key costs no more than any other.
    """
    if bounds not in ("global", "per_key"):
        raise ValueError(f"unknown bounds {bounds!r}")
    limits = [F.min(time).alias("_lo"), F.max(time).alias("_hi")]
    if start is not None and end is not None:
        base = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    elif bounds == "per_key" or not keys:
        base = df.groupBy(*keys).agg(*limits)
    else:
        base = attach(df.select(*keys).distinct(), df.agg(*limits), [])
    if start is not None:
        base = base.withColumn("_lo", F.lit(start).cast("date"))
    if end is not None:
        base = base.withColumn("_hi", F.lit(end).cast("date"))
    return base.select(*keys, F.explode(F.sequence("_lo", "_hi", bin_step(freq))).alias(time))


def _fill_between_rows(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Every row also emits the days since the row before it.

    Only the given rows are shuffled; the added days appear afterwards.
    """
    since = F.least(F.coalesce(F.date_add("_before", 1), F.col(time)), F.col(time))
    spread = previous_day(df, keys, time, "_before").withColumn("_day", F.explode(F.sequence(since, F.col(time))))
    own = F.col("_day") == F.col(time)
    return spread.select(*[
        F.col("_day").alias(c) if c == time else F.col(c) if c in keys else F.when(own, F.col(c)).alias(c)
        for c in df.columns])


def complete_calendar(
    df: DataFrame, keys: Sequence[str], time: str, fill: Mapping[str, float] | None = None,
    start=None, end=None, bounds: str = "global", freq: str = "day",
) -> DataFrame:
    """Reindex to the full calendar; columns in ``fill`` get a value, the rest stay null.

    A null key is a series like any other.
    """
    if bounds == "per_key" and freq == "day" and start is None and end is None:
        out = _fill_between_rows(df, keys, time)
    else:
        days = spine(df, keys, time, start, end, bounds, freq)
        out = join_keys(days, df, keys, [time], "left").select(*df.columns)
    for name, value in (fill or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value).cast(df.schema[name].dataType)))
    return out


def reindex_calendar(df: DataFrame, keys: Sequence[str], time: str, bounds: str = "per_key") -> DataFrame:
    """Full range between the first and last day of each series; nothing is filled."""
    return complete_calendar(df, keys, time, bounds=bounds)


def expected_row_count(df: DataFrame, keys: Sequence[str], time: str, start=None, end=None) -> DataFrame:
    """Rows per series against the number of calendar days, for series where they differ."""
    low = F.lit(start).cast("date") if start is not None else F.min(time)
    high = F.lit(end).cast("date") if end is not None else F.max(time)
    return (df.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 (F.datediff(high, low) + 1).cast("bigint").alias("expected_rows"))
            .where(F.col("n_rows") != F.col("expected_rows")))
