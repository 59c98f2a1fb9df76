"""Filters, projections and small tables behind the reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from daygrid.functions.columns import all_of, between_days, month_date, unit_scale, within_period
from daygrid.operators.blocks import attach, with_position


def filter_period(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Whole days ``start`` .. ``end``; the bounds are literals, so parquet can skip row groups."""
    is_date = dict(df.dtypes)[ts] == "date"
    return df.where(between_days(ts, start, end) if is_date else within_period(ts, start, end))


def equal_to(values: Mapping[str, object]) -> Column:
    """Conjunction of equalities; as the ``where`` of a scan it reaches the file."""
    return all_of([F.col(c) == F.lit(v) for c, v in values.items()])


def filter_equal(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.where(equal_to(values))


def filter_year(df: DataFrame, time: str, year: int) -> DataFrame:
    """One calendar year, as a date range so that it can be pushed to the scan."""
    return df.where(between_days(time, f"{year:04d}-01-01", f"{year:04d}-12-31"))


def filter_split(df: DataFrame, split: str = "test") -> DataFrame:
    return df.where(F.col("split") == split)


def last_year_window(df: DataFrame, keys: Sequence[str], time: str, days: int = 365) -> DataFrame:
    """Rows within ``days`` of the last day, both ends included."""
    last = df.groupBy(*keys).agg(F.max(time).alias("_last"))
    return attach(df, last, keys).where(F.col(time) >= F.date_sub("_last", days)).drop("_last")


def threshold_contingency(df: DataFrame, keys: Sequence[str], limits: Mapping[str, float]) -> DataFrame:
    """Counts by exceedance flags; ``limits`` maps a column to its (exclusive) limit."""
    flags = {f"{c}_above": F.col(c) > F.lit(v) for c, v in limits.items()}
    return (df.dropna(subset=list(limits)).withColumns(flags)
            .groupBy(*keys, *flags).agg(F.count(F.lit(1)).alias("n")))


def drop_incomplete(df: DataFrame, how: str = "any", subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how=how, subset=list(subset) if subset else None)


def rename_and_label(df: DataFrame, names: Mapping[str, str], code: str | None = None,
                     labels: Mapping[str, str] | None = None, label: str = "label") -> DataFrame:
    """Canonical column names, then a label looked up from a fixed dictionary."""
    out = df.withColumnsRenamed(dict(names))
    if code is None:
        return out
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return out.withColumn(label, F.try_element_at(table, F.col(code)))


def scatter_table(df: DataFrame, keys: Sequence[str], time: str, x: str, y: str) -> DataFrame:
    """Points with their year and their place in time from 0 (first) to 1 (last)."""
    placed = with_position(df.select(*keys, time, x, y), keys, time, "_i", total="_n")
    rank = F.when(F.col("_n") > 1, F.col("_i") / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    return placed.select(*keys, time, F.col(x).alias("x"), F.col(y).alias("y"),
                         F.year(time).cast("bigint").alias("year"), rank.alias("time_rank"))


def aligned_series(df: DataFrame, keys: Sequence[str], time: str, left: str, right: str) -> DataFrame:
    """Two measures on one time axis; rows missing the right one are dropped."""
    return df.select(*keys, time, left, right).dropna(subset=[right])


def monthly_balance(df: DataFrame, keys: Sequence[str], year: str, month: str, value: str,
                    name: str, divisor: float = 1.0) -> DataFrame:
    """Sum by (year, month), dated at the first of the month, in a larger unit."""
    total = df.groupBy(*keys, year, month).agg(F.sum(value).alias("_sum"))
    return total.select(*keys, month_date(year, month).alias("month"),
                        unit_scale("_sum", divisor).alias(name))
