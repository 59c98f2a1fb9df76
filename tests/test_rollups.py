"""Aggregation rules on small hand-made frames."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from conftest import days, rows
from daygrid.functions.columns import VOLUME_BANDS, band, band_order
from daygrid.operators.distribution import box_stats, density, histogram
from daygrid.operators.ranks import quantiles, running_counts, value_histogram
from daygrid.operators.rollup import (
    Measure, circular_mean, daily_distinct_count, daily_measures, multi_scale, resample, resample_legacy,
    target_profile, yearly_stats)
from daygrid.plans.base import ROLLUP

SCHEMA = ("day date, y bigint, rain double, temp double, speed_mean double, speed_max double, gust double, "
          "dir_sin double, dir_cos double")


def base(spark, n, start="2025-01-01", **over):
    out = []
    for i, d in enumerate(days(start, n)):
        row = {"day": d, "y": i + 1, "rain": float(i + 4), "temp": 20.0 + i, "speed_mean": 1.0 + i,
               "speed_max": 2.0 + i, "gust": 5.0 + i, "dir_sin": 0.0, "dir_cos": 1.0}
        row.update({k: v[i] for k, v in over.items()})
        out.append(tuple(row.values()))
    return spark.createDataFrame(out, SCHEMA)


def test_month_rules(spark):
    r = resample(base(spark, 2), [], "day", ROLLUP, "month", ("dir_sin", "dir_cos")).first()
    assert (r.y, r.rain, r.temp, r.speed_max, r.gust) == (3, 9.0, 20.5, 3.0, 6.0)


def test_week_ends_on_monday(spark):
    got = rows(resample(base(spark, 8, "2025-01-07"), [], "day", ROLLUP, "week_mon").select("bin", "y"), "bin")
    assert got == [(dt.date(2025, 1, 13), 28), (dt.date(2025, 1, 20), 8)]


def test_opposite_directions_have_no_mean(spark):
    r = resample(base(spark, 2, dir_cos=[1.0, -1.0]), [], "day", ROLLUP, "month", ("dir_sin", "dir_cos")).first()
    assert r.dir_sin is None and r.dir_cos is None


def test_missing_rain_stays_missing(spark):
    r = resample(base(spark, 2, rain=[None, None]), [], "day", ROLLUP, "month").first()
    assert r.rain is None
    legacy = resample_legacy(base(spark, 2, rain=[None, None]), [], "day", [Measure("rain", "sum_or_zero", "rain")],
                             [Measure("temp", "mean", "temp")], "month").first()
    assert legacy.rain == 0.0


def test_empty_bins_are_emitted_per_key(spark):
    data = [("a", dt.date(2025, 1, 1), 1.0), ("a", dt.date(2025, 3, 5), 2.0), ("b", dt.date(2025, 2, 1), 3.0)]
    df = spark.createDataFrame(data, "key string, day date, v double")
    got = rows(resample(df, ["key"], "day", [Measure("v", "sum", "v")], "month"), "key", "bin")
    assert got == [("a", dt.date(2025, 1, 1), 1.0), ("a", dt.date(2025, 2, 1), None),
                   ("a", dt.date(2025, 3, 1), 2.0), ("b", dt.date(2025, 2, 1), 3.0)]


def test_legacy_week_drops_bins_without_measure(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 5), 1.0, 2.0), (dt.date(2025, 1, 19), 1.0, 4.0)], "day date, y double, t double")
    got = rows(resample_legacy(df, [], "day", [Measure("y", "sum_or_zero", "y")], [Measure("t", "mean", "t")], "week_sun"), "bin")
    assert got == [(dt.date(2025, 1, 5), 1.0, 2.0), (dt.date(2025, 1, 19), 1.0, 4.0)]


def test_multi_scale_counts(spark):
    got = {r.scale: r["count"] for r in multi_scale(base(spark, 40), [], "day", ROLLUP, ("dir_sin", "dir_cos"))
           .groupBy("scale").count().collect()}
    assert got == {"day": 40, "week": 6, "month": 2}


def test_circular_mean_over_north(spark):
    df = spark.createDataFrame([("n", 359.0), ("n", 1.0), ("o", 0.0), ("o", 180.0), ("e", 90.0), ("z", None)], "k string, d double")
    got = {r.k: r.mean_angle for r in circular_mean(df, ["k"], "d").collect()}
    assert min(got["n"], 360 - got["n"]) < 1e-9
    assert got["o"] is None and got["z"] is None
    assert abs(got["e"] - 90) < 1e-9


def test_daily_measures(spark):
    df = spark.createDataFrame([("2025-01-01", 1.0, 0.0), ("2025-01-01", 2.0, None), ("2025-01-02", None, None)],
                               "day string, rain double, dir double").withColumn("day", F.to_date("day"))
    got = rows(daily_measures(df, [], "day", [Measure("rain", "sum", "rain"), Measure("n", "count", "rain")], "dir")
               .select("day", "rain", "n", "dir_sin", "dir_cos"), "day")
    assert got == [(dt.date(2025, 1, 1), 3.0, 2, 0.0, 1.0), (dt.date(2025, 1, 2), None, 0, None, None)]


def test_distinct_count_and_profile(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "day int, id string")
    assert rows(daily_distinct_count(df, [], "id", "day"), "day") == [(1, 2), (2, 1)]
    profile = target_profile(spark.createDataFrame([(0,), (4,), (1,), (3,)], "y bigint"), "y").first()
    assert (profile.events, profile.days, profile.zero_days, profile.daily_mean, profile.daily_max, profile.daily_median) == (8, 4, 1, 2.0, 4, 2.0)


def test_bands(spark):
    df = spark.createDataFrame([(199,), (200,), (400,), (401,), (None,)], "y int")
    got = rows(df.select("y", band("y").alias("b"), band_order("y").alias("o")), F.col("y").asc_nulls_last())
    assert [g[1] for g in got] == [VOLUME_BANDS[0], VOLUME_BANDS[1], VOLUME_BANDS[1], VOLUME_BANDS[2], None]
    assert [g[2] for g in got] == [0, 1, 1, 2, None]


def test_yearly_stats_of_one_day(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 1), 5), (dt.date(2024, 6, 1), 1), (dt.date(2024, 6, 2), 3)], "day date, y int")
    got = rows(yearly_stats(df, [], "day", "y", "2024-06-01"), "year")
    assert got == [(2023, 5.0, None, 1, False), (2024, 2.0, math.sqrt(2), 2, True)]


@pytest.mark.parametrize("buckets", [2, 3, 64])
def test_quantiles_match_the_builtin(spark, buckets):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.floor(F.pow(F.col("id") % 37, 2) / 5).cast("double").alias("v"))
    df = df.unionByName(spark.createDataFrame([(7, 1.5), (8, None)], "k long, v double"))
    got = {r.k: (r.a, r.b, r.c) for r in quantiles(df, ["k"], "v", {"a": 0.0, "b": 0.3, "c": 0.975}, buckets).collect()}
    want = {r.k: tuple(r.q) for r in df.where("v is not null").groupBy("k").agg(
        F.percentile("v", F.array(F.lit(0.0), F.lit(0.3), F.lit(0.975))).alias("q")).collect()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k])


def test_running_counts_with_one_dominant_value(spark):
    df = spark.range(300).select(F.when(F.col("id") < 100, 5).otherwise(F.col("id")).cast("double").alias("v"))
    ranked = {r.v: (r.before, r.cnt) for r in running_counts(value_histogram(df, [], "v"), [], "v", 8).collect()}
    assert ranked[5.0] == (0, 100)
    assert ranked[299.0] == (299, 1)


def test_box_histogram_density(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "v double").withColumn("g", F.lit("x"))
    box = box_stats(df, ["g"], "v").first()
    assert (box.q1, box.median, box.q3, box.whisker_low, box.whisker_high, box.fliers) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)
    bins = rows(histogram(df, "v", 3).select("bin", "n"), "bin")
    assert bins == [(0, 4), (2, 1)]
    constant = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert rows(histogram(constant, "v", 3).select("bin", "n")) == [(0, 2)]
    curve = density(df, "v", 400).toPandas().sort_values("x")
    area = ((curve.x.diff().iloc[1:]).to_numpy() * (curve.density.to_numpy()[1:] + curve.density.to_numpy()[:-1]) / 2).sum()
    assert abs(area - 1) < 0.01
    assert [(r.x, r.density) for r in density(constant, "v", 10).collect()] == [(2.0, None)] * 10
