"""Scans.  Every reader has an explicit schema and turns NaN into null."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from daygrid.functions.columns import scan_clean
from daygrid.operators.quality import (
    Guard, dedup_events, duplicate_keys, invalid_keys, read_sentinel, require, require_columns, require_complete_results,
    require_non_empty)
from daygrid.operators.shape import filter_period
from daygrid.sources.files import files_by_header


def scan_parquet(spark: SparkSession, path: str | Sequence[str], cols: Sequence[str] | None = None,
                 where=None) -> DataFrame:
    """Pruned and filtered at the file, then NaN to null.

    ``where`` sees the stored values, so it can be pushed to the scan; a filter
    on a cleaned double column could not.
    """
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    df = df.where(where) if where is not None else df
    return scan_clean(df.select(*cols) if cols else df)



def _by_header(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Text columns of CSV files that each have a header; files are matched by name, whatever the order of their columns.

    Files with one header are one scan, so thousands of yearly files stay a plan of a few scans.
    """
    reader = lambda: spark.read.option("header", True)
    literal = lambda path: re.sub(r"([\[\]{}*?\\])", r"\\\1", path)  # a listed name is no pattern
    groups = [[literal(p) for p in group] for group in files_by_header(spark, paths)]
    if not groups:
        return reader().csv(list(paths))
    tables = [reader().schema(reader().csv(group[0]).schema).csv(group) for group in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=False), tables)


def scan_events_csv(spark: SparkSession, paths: Sequence[str], event_id: str, start: str) -> DataFrame:
    """Two text columns of a wide CSV, then a parsed start; bad starts become null for ``invalid_keys``."""
    raw = _by_header(spark, paths)
    require_columns(raw, [event_id, start])
    return raw.select(F.col(event_id).alias("event_id"),
                      F.expr(f"try_cast(`{start}` AS timestamp_ntz)").alias("start"))


def unique_events(events: DataFrame, start, end, guard: Guard | None = None) -> DataFrame:
    """Valid events, one per id, inside the period; null ids or starts are refused, also those beside a good copy.

    With a ``guard`` the rules run in the write of the result, and the source is read and shuffled once.
    """
    if guard is None:
        require_non_empty(events, "the event source holds no records")
        # Before copies collapse: a good copy must not hide an unreadable one.
        require(invalid_keys(events, ["event_id", "start"]), "null event ids or unreadable starts")
        return filter_period(dedup_events(events, ["event_id"], "start"), "start", start, end)
    single = events.groupBy("event_id").agg(F.min("start").alias("start"), F.count_if(F.col("start").isNull()).alias("_unreadable"))
    rules = {"null event ids or unreadable starts": F.col("event_id").isNull() | (F.col("_unreadable") > 0)}
    single = guard.watch(single, rules, ["event_id", "start"], empty="the event source holds no records")
    return filter_period(single.drop("_unreadable"), "start", start, end)


def scan_hourly_csv(spark: SparkSession, paths: Sequence[str], names: dict[str, str], day: str, hour: str,
                    sentinel: float | None = None) -> DataFrame:
    """Several yearly files in one read; ``names`` maps file columns to measures, unreadable numbers are null."""
    raw = _by_header(spark, paths)
    require_columns(raw, [day, hour, *names])
    numbers = [F.expr(f"try_cast(`{src}` AS double)").alias(dst) for src, dst in names.items()]
    out = scan_clean(raw.select(F.expr(f"try_cast(`{day}` AS date)").alias("day"), F.col(hour).alias("hour"), *numbers))
    return read_sentinel(out, list(names.values()), sentinel) if sentinel is not None else out


BALANCE_SCHEMA = T.StructType([
    T.StructField("tax_id", T.StringType()), T.StructField("modality", T.StringType()),
    T.StructField("flow", T.StringType()), T.StructField("item", T.StringType()),
    T.StructField("detail", T.StringType()), T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()), T.StructField("value", T.DoubleType())])


def scan_drop_malformed(spark: SparkSession, paths: Sequence[str], schema: T.StructType = BALANCE_SCHEMA) -> DataFrame:
    """Lines that do not fit the schema are skipped; ids stay text, so leading zeros survive.

    Every column is parsed whatever a query selects, so the skipped lines do not
    depend on it.  Columns are taken by position, under the schema's names.
    """
    marked = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True)
             .option("columnNameOfCorruptRecord", "_corrupt").schema(marked).csv(list(paths)))
    # The second condition always holds; it makes the parser read every column.
    every = F.concat_ws("", *[F.col(f.name).cast("string") for f in schema.fields])
    return scan_clean(lines.where(F.col("_corrupt").isNull() & (F.length(every) >= 0)).drop("_corrupt"))


def check_daily_base(df: DataFrame, keys: Sequence[str], time: str, required: Sequence[str]) -> DataFrame:
    """Columns present, not empty, one row per key and day."""
    require_columns(df, [*keys, time, *required])
    require_non_empty(df)
    require(duplicate_keys(df, [*keys, time]), "the daily base repeats dates")
    return df


def load_daily_base(spark: SparkSession, path: str, keys: Sequence[str], time: str, required: Sequence[str]) -> DataFrame:
    return check_daily_base(scan_parquet(spark, path), keys, time, required)


def load_multi_horizon_results(spark: SparkSession, folder: str, models: Sequence[str] = (), horizons: Sequence[int] = (),
                               test: tuple | None = None, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Metrics and long predictions written by :func:`daygrid.sources.sinks.write_outputs`.

    With ``models``, ``horizons`` and ``test`` the predictions have to be exactly those: every day of
    the test period once for every pair (and series), nothing missing, nothing else.
    """
    metrics = spark.read.parquet(f"{folder}/metrics")
    preds = require_columns(spark.read.parquet(f"{folder}/predictions"),
                            ["model", "horizon", "origin", "target", "y_real", "y_pred"])
    if test is not None:
        require_complete_results(preds, models, horizons, *test, keys)
    return metrics, preds


__all__ = ["BALANCE_SCHEMA", "check_daily_base", "load_daily_base", "load_multi_horizon_results",
           "scan_drop_malformed", "scan_events_csv", "scan_hourly_csv", "scan_parquet", "unique_events"]
