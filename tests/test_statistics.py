"""Correlations, autocorrelation and tests against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import days, rows
from daygrid.operators.association import (
    acf, chi2_upper, complete_pairs, cross_correlation, kendall_matrix, linear_fit, ljung_box, pacf, partial_from_acf,
    pearson, pearson_matrix, pearson_with, spearman_matrix, top_correlations)


def sample(n=80, seed=2, levels=6):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, levels, n).astype(float)
    y = np.round(x + rng.normal(0, 2, n))
    z = rng.normal(0, 1, n)
    z[::9] = np.nan
    return pd.DataFrame({"key": np.where(np.arange(n) % 4 == 0, "b", "a"), "day": days("2020-01-01", n), "x": x, "y": y, "z": z})


def to_spark(spark, pdf):
    clean = pdf.astype(object).where(pdf.notna(), None)
    return spark.createDataFrame(clean.values.tolist(), "key string, day date, x double, y double, z double")


def brute_tau(x, y):
    sx, sy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    return (sx * sy).sum() / math.sqrt((sx ** 2).sum() * (sy ** 2).sum())


def test_spearman_ranks_each_pair_on_its_own_rows(spark):
    pdf = sample()
    got = {(r.key, r.var_a, r.var_b): r.rho for r in spearman_matrix(to_spark(spark, pdf), ["x", "y", "z"], ["key"]).collect()}
    assert len(got) == 6
    for (key, a, b), rho in got.items():
        ranks = pdf.loc[pdf.key == key, [a, b]].dropna().rank()
        assert rho == pytest.approx(ranks[a].corr(ranks[b]))


@pytest.mark.parametrize("size", [2, 4096])
def test_kendall(spark, size):
    pdf = sample()
    got = {(r.var_a, r.var_b): r.tau for r in kendall_matrix(to_spark(spark, pdf), ["x", "y", "z"], size=size).collect()}
    assert len(got) == 3
    for (a, b), tau in got.items():
        both = pdf[[a, b]].dropna().to_numpy()
        assert tau == pytest.approx(brute_tau(both[:, 0], both[:, 1]))


def test_kendall_by_key_and_heavy_ties(spark):
    rng = np.random.default_rng(4)
    pdf = sample(300, levels=2)
    pdf["y"] = np.where(rng.random(300) < 0.4, 1.0, pdf.y)
    got = {r.key: r.tau for r in kendall_matrix(to_spark(spark, pdf), ["x", "y"], ["key"], size=5).collect()}
    for key, part in pdf.groupby("key"):
        assert got[key] == pytest.approx(brute_tau(part.x.to_numpy(), part.y.to_numpy()))


def test_constant_columns_give_null(spark):
    df = spark.createDataFrame([("k", d, 1.0, float(i), None) for i, d in enumerate(days("2020-01-01", 5))],
                               "key string, day date, x double, y double, z double")
    assert pearson(df, "y", "x").first().r is None
    assert {r.tau for r in kendall_matrix(df, ["x", "y"]).collect()} == {None}
    assert {r.rho for r in spearman_matrix(df, ["x", "y"]).collect()} == {None}
    assert {r.r for r in cross_correlation(df, ["key"], "day", "x", "y", 2).collect()} == {None}
    assert all(r.acf is None for r in acf(df, ["key"], "day", "x", 3).collect())
    assert all(r.pacf is None for r in pacf(df, ["key"], "day", "x", 3).collect())
    assert complete_pairs(df, ["x", "z"]).count() == 0
    fit = linear_fit(df, "x", "y").first()
    assert (fit.slope, fit.intercept, fit.r2) == (None, None, None)
    flat = linear_fit(df, "y", "x").first()
    assert flat.slope == 0 and flat.r2 is None
    one = linear_fit(df.limit(1), "y", "x").first()
    assert one.slope is None


def test_pearson(spark):
    pdf = sample()
    df = to_spark(spark, pdf)
    got = {(r.var_a, r.var_b): r.r for r in pearson_matrix(df, ["x", "y", "z"]).collect()}
    want = pdf[["x", "y", "z"]].corr()
    assert len(got) == 6
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b])
    long = pearson_with(df, "y", ["x", "z"], ["key"])
    assert long.count() == 4
    assert rows(top_correlations(long, n=2).select(F.abs("r") > 0)) == [(True,), (True,)]


@pytest.mark.parametrize("size", [10, 4096])
def test_cross_correlation_sign(spark, size):
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    y = np.r_[np.zeros(3), x[:-3]] + 0.1 * rng.normal(size=200)
    pdf = pd.DataFrame({"key": "a", "day": days("2020-01-01", 200), "x": x, "y": y, "z": 0.0})
    pdf.loc[[10, 50], "x"] = np.nan
    got = {r.lag: r.r for r in cross_correlation(to_spark(spark, pdf), ["key"], "day", "x", "y", 5, size=size).collect()}
    clean = pdf.dropna()
    cx = (clean.x - clean.x.mean()) / (clean.x.std(ddof=0) * len(clean))
    cy = (clean.y - clean.y.mean()) / clean.y.std(ddof=0)
    full = np.correlate(cy, cx, "full")
    for k in range(-5, 6):
        assert got[k] == pytest.approx(full[len(clean) - 1 + k])
    assert max(got, key=got.get) == 3


@pytest.mark.parametrize("size", [9, 4096])
def test_acf_pacf_ljung_box(spark, size):
    rng = np.random.default_rng(7)
    v = np.zeros(150)
    for i in range(1, 150):
        v[i] = 0.6 * v[i - 1] + rng.normal()
    pdf = pd.DataFrame({"key": "a", "day": days("2020-01-01", 150), "x": v, "y": v, "z": v})
    table = acf(to_spark(spark, pdf), ["key"], "day", "x", 14, size=size)
    got = {r.lag: r for r in table.collect()}
    c = v - v.mean()
    want = [float((c[:150 - k] * c[k:]).sum() / (c * c).sum()) for k in range(15)]
    for k in range(15):
        assert got[k].acf == pytest.approx(want[k])
        assert got[k].band == pytest.approx(1.96 / math.sqrt(150))
    assert got[1].bartlett == pytest.approx(1.96 / math.sqrt(150))
    assert got[3].bartlett == pytest.approx(1.96 * math.sqrt((1 + 2 * (want[1] ** 2 + want[2] ** 2)) / 150))
    tests = {r.lag: r for r in ljung_box(table, ["key"]).collect()}
    q7 = 150 * 152 * sum(want[k] ** 2 / (150 - k) for k in range(1, 8))
    assert tests[7].q == pytest.approx(q7) and 0 <= tests[7].p_value < 1e-6
    part = {r.lag: r.pacf for r in pacf(to_spark(spark, pdf), ["key"], "day", "x", 6).collect()}
    for k in range(1, 7):  # Yule-Walker: the last coefficient of the order-k system
        matrix = np.array([[want[abs(i - j)] for j in range(k)] for i in range(k)])
        assert part[k] == pytest.approx(np.linalg.solve(matrix, np.array(want[1:k + 1]))[-1])
    assert part[0] == 1.0


def test_chi_squared_tail():
    assert chi2_upper(0.0, 7) == pytest.approx(1.0)
    # 95% points of the distribution.
    assert chi2_upper(14.067140449340169, 7) == pytest.approx(0.05)
    assert chi2_upper(23.684791304840576, 14) == pytest.approx(0.05)
    assert chi2_upper(3.841458820694124, 1) == pytest.approx(0.05)
    assert partial_from_acf([1.0, 0.5]) == [1.0, 0.5]


def test_linear_fit(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(5)] + [(None, 3.0)], "x double, y double")
    r = linear_fit(df, "x", "y").first()
    assert (r.n, r.slope, r.intercept, r.r2) == (5, pytest.approx(2), pytest.approx(1), pytest.approx(1))
