"""Window operators against pandas, with blocks small enough to be crossed often."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import days, rows
from daygrid.operators.blocks import with_position
from daygrid.operators.windows import (
    calendar_features, causal_columns, causal_fill, decompose_additive, ema, ema_reach, fill_with_train_median,
    interpolate_linear, interpolate_time, lags, lead_target, renormalise_direction, rolling_mean, rolling_std,
    sequence_windows, undefined_directions)
from daygrid.plans.features import READINGS, build_features, feature_columns

SIZES = [3, 4096]


def frame(n=60, seed=1, missing=0.0):
    rng = np.random.default_rng(seed)
    parts = []
    for key, length, start in (("a", n, "2020-01-01"), ("b", n // 3, "2020-02-11"), ("c", 1, "2020-01-05")):
        v = rng.normal(10, 3, length)
        v[rng.random(length) < missing] = np.nan
        parts.append(pd.DataFrame({"key": key, "day": days(start, length), "v": v}))
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, pdf):
    clean = pdf.astype(object).where(pdf.notna(), None)
    return spark.createDataFrame(clean.values.tolist(), "key string, day date, v double")


def compare(df, pdf, columns):
    got = df.toPandas().sort_values(["key", "day"]).reset_index(drop=True)
    want = pdf.sort_values(["key", "day"]).reset_index(drop=True)
    assert len(got) == len(want)
    for c in columns:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


@pytest.mark.parametrize("size", SIZES)
def test_lags_and_rolling(spark, size):
    pdf = frame()
    df, g = to_spark(spark, pdf), pdf.groupby("key").v
    for k in (1, 7):
        pdf[f"v_lag_{k}"] = g.shift(k)
    pdf["v_mean_14d"] = g.transform(lambda s: s.rolling(14, min_periods=1).mean())
    pdf["v_std_7d"] = g.transform(lambda s: s.rolling(7).std())
    compare(lags(df, ["key"], "day", ["v"], [1, 7], size=size), pdf, ["v_lag_1", "v_lag_7"])
    compare(rolling_mean(df, ["key"], "day", ["v"], [14], size=size), pdf, ["v_mean_14d"])
    compare(rolling_std(df, ["key"], "day", ["v"], 7, size=size), pdf, ["v_std_7d"])


@pytest.mark.parametrize("size,spans", [(50, [1, 2]), (50, [3, 7, 14]), (700, [3, 7, 14]), (4096, [3, 7, 14]), (4096, [365])])
def test_ema(spark, size, spans):
    pdf = frame(1500)
    for s in spans:
        pdf[f"v_ema_{s}"] = pdf.groupby("key").v.transform(lambda x: x.ewm(span=s, adjust=False).mean())
    compare(ema(to_spark(spark, pdf[["key", "day", "v"]]), ["key"], "day", ["v"], spans, size=size), pdf, [f"v_ema_{s}" for s in spans])


def test_ema_spans_too_far_apart():
    with pytest.raises(ValueError):
        ema_reach([2, 1000])
    assert ema_reach([3, 7, 14]) == 323


@pytest.mark.parametrize("size", SIZES)
def test_interpolation(spark, size):
    pdf = frame(missing=0.6, seed=3)
    df = to_spark(spark, pdf)
    linear = pdf.copy()
    linear["v"] = pdf.groupby("key").v.transform(lambda s: s.interpolate("linear", limit_direction="both"))
    compare(interpolate_linear(df, ["key"], "day", ["v"], size=size), linear, ["v"])
    past = pdf.copy()
    past["v"] = pdf.groupby("key").v.ffill()
    compare(causal_fill(df, ["key"], "day", ["v"], size=size), past, ["v"])
    # Irregular dates: drop some rows, then weight by elapsed days.
    thin = pdf[pdf.index % 3 != 1].reset_index(drop=True)
    timed = thin.copy()
    timed["v"] = np.concatenate([
        pd.Series(g.v.to_numpy(), index=pd.DatetimeIndex(g.day)).interpolate("time").to_numpy()
        for _, g in thin.groupby("key", sort=True)])
    compare(interpolate_time(to_spark(spark, thin), ["key"], "day", ["v"], size=size), timed, ["v"])


def test_interpolation_of_nothing(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), None)], "key string, day date, v double")
    assert rows(interpolate_linear(df, ["key"], "day", ["v"]).select("v")) == [(None,)]
    assert interpolate_linear(df.limit(0), ["key"], "day", ["v"]).count() == 0


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("period", [4, 7])
def test_decomposition(spark, size, period):
    pdf = frame(seed=5)[lambda d: d.key == "a"].reset_index(drop=True)
    n, half = len(pdf), period // 2
    weights = np.r_[0.5, np.ones(period - 1), 0.5] / period if period % 2 == 0 else np.ones(period) / period
    trend = np.full(n, np.nan)
    trend[half:n - half] = np.convolve(pdf.v, weights, "valid")
    detrended = pdf.v.to_numpy() - trend
    means = np.array([np.nanmean(detrended[i::period]) for i in range(period)])
    seasonal = np.tile(means - means.mean(), n // period + 1)[:n]
    want = pdf.assign(trend=trend, seasonal=seasonal, residual=detrended - seasonal)
    compare(decompose_additive(to_spark(spark, pdf), ["key"], "day", "v", period, size=size), want, ["trend", "seasonal", "residual"])
    alone = decompose_additive(to_spark(spark, pdf).drop("key"), [], "day", "v", period, size=size)
    compare(alone.withColumn("key", F.lit("a")), want, ["trend", "seasonal", "residual"])


def test_calendar_codes(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 31),), (dt.date(2024, 1, 1),)], "day date")
    got = rows(calendar_features(df, "day"), "day")
    assert got[0][1:4] == (1, 0, 1) and got[1][1:4] == (12, 1, 366)
    assert got[1][4] == pytest.approx(0, abs=1e-12) and got[1][5] == pytest.approx(1)


@pytest.mark.parametrize("size", SIZES)
def test_leads_and_sequences(spark, size):
    data = [("a", d, float(i)) for i, d in enumerate(days("2020-01-01", 40))]
    df = spark.createDataFrame(data, "key string, day date, v double")
    lead = rows(lead_target(df, ["key"], "day", "v", 7, size=size), "day")
    assert len(lead) == 33 and lead[0][3] == 7.0 and lead[0][4] == dt.date(2020, 1, 8)
    windows = sequence_windows(df.withColumn("w", F.col("v") * 10), ["key"], "day", ["v", "w"], "v", 14, 7, size=size).orderBy("origin").collect()
    assert len(windows) == 40 - 14 - 7 + 1
    first = windows[0]
    assert first.window[-1] == [13.0, 130.0] and first.label == 20.0 and (first.target - first.origin).days == 7
    assert [step[0] for step in windows[-1].window] == [float(i) for i in range(19, 33)]


def test_sequences_skip_missing(spark):
    data = [("a", d, None if i == 5 else float(i)) for i, d in enumerate(days("2020-01-01", 12))]
    df = spark.createDataFrame(data, "key string, day date, v double")
    got = sequence_windows(df, ["key"], "day", ["v"], "v", 3, 1)
    assert {r.origin.day for r in got.collect()} == {3, 4, 9, 10, 11}


def test_direction_after_interpolation(spark):
    df = spark.createDataFrame([("a", d, s, c) for d, s, c in zip(days("2020-01-01", 3), (0.0, None, 1.0), (1.0, None, 0.0))],
                               "key string, day date, dir_sin double, dir_cos double")
    filled = interpolate_linear(df, ["key"], "day", ["dir_sin", "dir_cos"])
    assert undefined_directions(filled).count() == 0
    got = renormalise_direction(filled).select(F.hypot("dir_sin", "dir_cos").alias("n")).collect()
    assert all(r.n == pytest.approx(1) for r in got)
    opposite = spark.createDataFrame([(0.0, 0.0)], "dir_sin double, dir_cos double")
    assert undefined_directions(opposite).count() == 1


def test_train_median_does_not_see_the_test_part(spark):
    data = [("a", d, v) for d, v in zip(days("2020-01-01", 6), (1.0, None, 3.0, None, 100.0, None))]
    df = spark.createDataFrame(data, "key string, day date, v double")
    got = [r[0] for r in rows(fill_with_train_median(df, ["key"], "day", ["v"], "2020-01-04").orderBy("day").select("v"))]
    assert got == [1.0, 2.0, 3.0, 2.0, 100.0, 2.0]


def test_positions_close_up(spark):
    pdf = frame(200).iloc[::3]
    want = pdf.assign(pos=pdf.groupby("key").cumcount(), n=pdf.groupby("key").v.transform("size"),
                      _mean_v=pdf.groupby("key").v.transform("mean"))
    got = with_position(to_spark(spark, pdf), ["key"], "day", total="n", means=["v"], size=8)
    compare(got, want, ["pos", "n", "_mean_v"])


def pandas_features(pdf):
    out = pdf.set_index("day").copy()
    out.index = pd.DatetimeIndex(out.index)
    out = out.reindex(pd.date_range(out.index.min(), out.index.max()))
    out[list(READINGS)] = out[list(READINGS)].astype(float).interpolate("linear", limit_direction="both")
    norm = np.hypot(out.dir_sin, out.dir_cos)
    out["dir_sin"], out["dir_cos"] = out.dir_sin / norm, out.dir_cos / norm
    out["month"], out["weekday"], out["day_of_year"] = out.index.month, out.index.dayofweek, out.index.dayofyear
    out["month_sin"], out["month_cos"] = np.sin(2 * np.pi * out.month / 12), np.cos(2 * np.pi * out.month / 12)
    for c in ("y", "rain", "temp", "gust"):
        for k in (1, 2, 3, 7):
            out[f"{c}_lag_{k}"] = out[c].shift(k)
    for c in ("rain", "temp", "gust"):
        for s in (3, 7, 14):
            out[f"{c}_ema_{s}"] = out[c].ewm(span=s, adjust=False).mean()
        out[f"{c}_std_7d"] = out[c].rolling(7).std()
    return out.dropna()


@pytest.mark.parametrize("size", [100, 4096])
def test_feature_table_matches_pandas(spark, size):
    rng = np.random.default_rng(9)
    n = 400
    pdf = pd.DataFrame({"day": days("2020-01-01", n), "y": rng.integers(0, 50, n).astype(float)})
    for c in READINGS:
        pdf[c] = rng.normal(5, 2, n)
    pdf.loc[rng.choice(n, 30, replace=False), "temp"] = np.nan
    want = pandas_features(pdf)
    clean = pdf.astype(object).where(pdf.notna(), None)
    df = spark.createDataFrame(clean.values.tolist(), "day date, y double, " + ", ".join(f"{c} double" for c in READINGS))
    table = build_features(df, [], size=size)
    names = feature_columns()
    assert len(names) == 41 and set(table.columns) == {"day", *names}
    got = table.toPandas().sort_values("day")
    assert len(got) == len(want) == n - 7
    for c in names:
        np.testing.assert_allclose(got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy(), rtol=1e-9, atol=1e-9, err_msg=c)


def test_one_exchange_for_all_causal_columns(spark):
    df = spark.range(100).select(F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).alias("day"),
                                 F.col("id").cast("double").alias("v"), F.lit("k").alias("key"))
    table = causal_columns(df, ["key"], "day", lag=(["v"], [1, 7]), ema=(["v"], [3, 14]), std=(["v"], 7))
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
