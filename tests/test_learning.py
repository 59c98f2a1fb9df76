"""Splits, scalers, forecasts, metrics and the bootstrap."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import days, rows
from daygrid.operators.bootstrap import (
    block_indices, block_sensitivity, block_starts, bootstrap_differences, bootstrap_intervals, bootstrap_means)
from daygrid.operators.evaluate import (
    band_mae, best_by_group, forecast_metrics, metrics_by_split, monthly_metrics, pivot_metric, residual_diagnostics,
    winner_counts)
from daygrid.operators.forecast import (
    baseline_table, moving_average_forecast, persistence, persistence_suite, recut_predictions, union_model_results)
from daygrid.operators.joins import missing_offsets, models_side_by_side
from daygrid.operators.learning import (
    direct_task, feature_groups, minmax_inverse, minmax_scale, minmax_stats, multi_horizon_task, split_by_cut_date,
    split_by_fraction, split_last_rows, standardize, time_series_folds, zscore)
from daygrid.operators.models import (
    ablation, boosted_trees, boosted_trees_by_horizon, direct_arx, direct_forecast, feature_importance, grid_search, regressor, side_by_side)
from daygrid.operators.quality import QualityError, no_leakage
from daygrid.plans.experiment import run_experiment
from daygrid.plans.features import CALENDAR, feature_columns

PRED = "model string, horizon int, origin date, target date, y_real double, y_pred double"


def series(spark, n, start="2020-01-01", f=float, key=None):
    data = [(d, float(f(i))) for i, d in enumerate(days(start, n))]
    df = spark.createDataFrame(data, "day date, y double")
    return df.withColumn("key", F.lit(key)) if key else df


# --- splits and scalers ---------------------------------------------------------------------------


def test_split_fractions_per_key(spark):
    df = series(spark, 10, key="a").unionByName(series(spark, 7, key="b"))
    got = {(r.key, r.split): r["count"] for r in split_by_fraction(df, ["key"], "day").groupBy("key", "split").count().collect()}
    assert got == {("a", "train"): 8, ("a", "test"): 2, ("b", "train"): 5, ("b", "test"): 2}
    last = split_last_rows(df, ["key"], "day", 3).where("split = 'test'").groupBy("key").count().collect()
    assert {r.key: r["count"] for r in last} == {"a": 3, "b": 3}


def test_split_by_target_date(spark):
    task = direct_task(series(spark, 913, "2022-12-01"), [], "day", "y", 14, "2024-06-14", "2025-05-31", train_end="2024-05-31")
    test = task.where("split = 'test'")
    r = test.agg(F.count("*"), F.min("target"), F.max("target"), F.min(F.datediff("target", "origin")), F.max(F.datediff("target", "origin"))).first()
    assert tuple(r) == (352, dt.date(2024, 6, 14), dt.date(2025, 5, 31), 14, 14)
    by = task.withColumn("horizon", F.lit(14))
    assert no_leakage(by.where("split = 'train'"), by.where("split = 'test'")).count() == 0
    late = by.withColumn("origin", F.date_sub("origin", 40))
    assert no_leakage(by.where("split = 'train'"), late.where("split = 'test'")).count() == 1


def test_scaler_sees_training_rows_only(spark):
    df = series(spark, 220).withColumn("twice", F.col("y") * 2).withColumn("flat", F.lit(3.0))
    split = df.withColumn("split", F.when(F.col("y") < 200, "train").otherwise("test"))
    stats = minmax_stats(split, [], ["y", "twice"]).first()
    assert (stats._hi_y, stats._hi_twice) == (199.0, 398.0)
    scaled = minmax_scale(split, [], ["y", "twice", "flat"], keep_stats=True)
    top = scaled.agg(F.max("y"), F.max("flat")).first()
    assert top[0] == pytest.approx(219 / 199) and top[1] == 0.0
    back = minmax_inverse(scaled, ["y", "twice", "flat"]).orderBy("day").first()
    assert (back.y, back.twice, back.flat) == (0.0, 0.0, 3.0)


def test_standard_scores(spark):
    df = spark.createDataFrame([("train", 1.0, 5.0), ("train", 3.0, 5.0), ("test", 5.0, 6.0)], "split string, v double, flat double")
    got = rows(standardize(df, [], ["v", "flat"]).where("split = 'test'").select("v", "flat"))
    assert got == [(3.0, 1.0)]
    z = rows(zscore(df, [], ["v", "flat"]).where("split = 'test'").select("v", "flat"))
    assert z == [(pytest.approx(3 / math.sqrt(2)), 1.0)]
    single = df.where("v < 3")
    assert rows(zscore(single, [], ["v"]).select("v")) == [(0.0,)]


def test_folds_expand(spark):
    got = {(r.fold, r.role): (r.n, r.lo, r.hi) for r in time_series_folds(series(spark, 20), [], "day").groupBy("fold", "role").agg(
        F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi")).collect()}
    assert got[(0, "train")] == (5, 0.0, 4.0) and got[(0, "test")] == (3, 5.0, 7.0)
    assert got[(4, "train")] == (17, 0.0, 16.0) and got[(4, "test")] == (3, 17.0, 19.0)


def test_feature_groups():
    rules = {"history": lambda c: c == "y" or c.startswith("y_lag_"), "calendar": lambda c: c in CALENDAR}
    rules["weather"] = lambda c: not rules["history"](c) and not rules["calendar"](c)
    groups = feature_groups(feature_columns(), rules)
    names = [n for g in groups.values() for n in g]
    assert sorted(names) == sorted(feature_columns()) and len(names) == len(set(names))
    assert groups["history"] == ["y", "y_lag_1", "y_lag_2", "y_lag_3", "y_lag_7"]
    with pytest.raises(ValueError):
        feature_groups(["y"], {"a": lambda c: True, "b": lambda c: True})
    with pytest.raises(ValueError):
        feature_groups(["y"], {"a": lambda c: False})


# --- baselines and metrics --------------------------------------------------------------------------


def test_persistence_and_missing_origins(spark):
    df = series(spark, 30)
    p = persistence(df, [], "day", "y", 3, "2020-01-10", "2020-01-12")
    assert [(r.y_real, r.y_pred) for r in p.orderBy("target").collect()] == [(9.0, 6.0), (10.0, 7.0), (11.0, 8.0)]
    assert missing_offsets(df, [], "day", 3, "2020-01-10", "2020-01-12").count() == 0
    assert missing_offsets(df.where("y != 6"), [], "day", 3, "2020-01-10", "2020-01-12").count() == 1
    suite = persistence_suite(df, [], "day", "y", [("x", 1, "2020-01-05", "2020-01-06"), ("z", 7, "2020-01-20", "2020-01-20")])
    assert rows(forecast_metrics(suite, ["scope", "horizon"]).select("scope", "n", "mae"), "scope") == [("x", 2, 1.0), ("z", 1, 7.0)]


def test_moving_average(spark):
    got = {r.target.day: r.y_pred for r in moving_average_forecast(series(spark, 12), [], "day", "y").collect()}
    assert got[1] is None and got[2] == 0.0 and got[4] == 1.0 and got[9] == 4.0
    table = baseline_table(series(spark, 10), [], "day", "y")
    m = {(r.model, r.split): (r.mae, r.n) for r in metrics_by_split(table, "y", ["persistence", "mean_7d"]).collect()}
    assert m[("persistence", "train")] == (1.0, 7) and m[("persistence", "test")] == (1.0, 2)


def one_group(spark, pairs):
    data = [("m", 1, d, d + dt.timedelta(days=1), float(a), float(b)) for d, (a, b) in zip(days("2024-01-01", len(pairs)), pairs)]
    return spark.createDataFrame(data, PRED)


def test_metrics(spark):
    r = forecast_metrics(one_group(spark, [(10, 8), (20, 24)])).first()
    assert (r.n, r.mae, r.rmse, r.r2, r.mape) == (2, 3.0, pytest.approx(math.sqrt(10)), pytest.approx(0.6), pytest.approx(20))
    assert forecast_metrics(one_group(spark, [(0, 50), (100, 80)])).first().mape == pytest.approx(20)
    zero = forecast_metrics(one_group(spark, [(0, 1), (0, 2)])).first()
    assert zero.mape is None and zero.r2 is None
    assert forecast_metrics(one_group(spark, [(1, 1)])).first().r2 is None
    assert forecast_metrics(one_group(spark, [(1, -5), (2, 2)])).first().mae == 0.5
    assert forecast_metrics(one_group(spark, [(1, 1)]).limit(0)).count() == 0


def test_monthly_best_and_pivot(spark):
    data = [(m, 1, d, d, 10.0, 10.0 + e) for m, e in (("a", 1.0), ("b", 1.0), ("c", 2.0)) for d in days("2024-01-30", 4)]
    monthly = monthly_metrics(spark.createDataFrame(data, PRED))
    assert monthly.count() == 6
    assert {r.mean_error for r in monthly.where("model = 'c'").collect()} == {-2.0}
    best = best_by_group(monthly, ["month", "horizon"])
    assert {r.best_model for r in best.collect()} == {"a"}
    assert rows(winner_counts(best)) == [(1, "a", 2)]
    wide = pivot_metric(monthly, ["month"], "model", ["a", "c"], "mae")
    assert rows(wide.select("a", "c")) == [(1.0, 2.0), (1.0, 2.0)]


def test_band_mae_uses_the_canonical_target(spark):
    truth = [199.0, 200.0, 400.0, 401.0]
    ds = days("2024-01-01", 4)
    target = spark.createDataFrame(list(zip(ds, truth)), "day date, y double")
    data = [(m, 1, d, d, -999.0, y + e) for m, e in (("a", 1.0), ("b", 2.0), ("c", 3.0)) for d, y in zip(ds, truth)]
    got = band_mae(spark.createDataFrame(data, PRED), target, ["a", "b", "c"]).collect()
    assert sorted(r.days for r in got) == [1, 1, 2] and sum(r.percent for r in got) == pytest.approx(100)
    assert all((r.a, r.b, r.c) == (1.0, 2.0, 3.0) for r in got)
    with pytest.raises(QualityError):
        band_mae(spark.createDataFrame(data, PRED), target.where("y > 199"), ["a", "b", "c"])


def test_residual_diagnostics(spark):
    rng = np.random.default_rng(1)
    e = rng.normal(2, 1, 60)
    r = residual_diagnostics(one_group(spark, [(v, 0.0) for v in e])).first()
    c = e - e.mean()
    assert r.mean_residual == pytest.approx(e.mean()) and r.median_residual == pytest.approx(np.median(e))
    assert r.std_residual == pytest.approx(e.std(ddof=1)) and r.acf_7 == pytest.approx((c[:-7] * c[7:]).sum() / (c * c).sum())
    assert 0 < r.ljung_box_p_7 <= 1 and 0 < r.ljung_box_p_14 <= 1


def test_union_and_recut(spark):
    t = spark.createDataFrame([(dt.date(2024, 1, 2), 1.0, 2.0), (dt.date(2024, 2, 2), 1.0, 2.0)], "day date, real double, pred double")
    long = union_model_results({"a": t, "b": t})
    assert long.count() == 4 and long.first().origin == dt.date(2024, 1, 1)
    assert recut_predictions(long, "2024-02-01", "2024-02-28").count() == 2


# --- bootstrap --------------------------------------------------------------------------------------


def test_repeated_dates_are_refused(spark):
    df = spark.createDataFrame([(d, 1.0, 2.0) for d in (*days("2024-01-01", 9), dt.date(2024, 1, 4))], "target date, y_real double, a double")
    with pytest.raises(Exception, match="occurs twice"):
        bootstrap_intervals(df, ["a"], resamples=5, block_length=3).collect()
    assert bootstrap_intervals(df.distinct(), ["a"], resamples=5, block_length=3).first().bias == -1.0


def test_block_indices_are_consecutive_and_repeatable(spark):
    lengths = spark.createDataFrame([(20,)], "n bigint")
    first = block_indices(lengths, 4, 5).orderBy("resample", "place").collect()
    assert first == block_indices(lengths, 4, 5).orderBy("resample", "place").collect()
    table = np.array([r["index"] for r in first]).reshape(4, 4, 5)
    assert ((np.diff(table, axis=2) % 20) == 1).all()
    assert len({tuple(t.ravel()) for t in table}) > 1
    with pytest.raises(ValueError):
        block_starts(lengths, 0, 5)
    with pytest.raises(ValueError):
        block_starts(lengths, 4, 0)
    assert block_indices(spark.createDataFrame([(17,)], "n bigint"), 3, 5).count() == 51


def wide(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    real = rng.normal(50, 10, n)
    a, b = real + rng.normal(0, 3, n), real + rng.normal(1, 5, n)
    pdf = pd.DataFrame({"target": days("2024-01-01", n), "y_real": real, "a": a, "b": b})
    return pdf, spark.createDataFrame(pdf.values.tolist(), "target date, y_real double, a double, b double")


@pytest.mark.parametrize("n,length", [(40, 7), (35, 7), (5, 7), (7, 7), (30, 1)])
def test_bootstrap_equals_gathering_the_indices(spark, n, length):
    pdf, df = wide(spark, n)
    lengths = spark.createDataFrame([(n,)], "n bigint")
    idx = np.array([r["index"] for r in block_indices(lengths, 50, length).orderBy("resample", "place").collect()]).reshape(50, n)
    got = {r.model: r for r in bootstrap_intervals(df, ["a", "b"], resamples=50, block_length=length).collect()}
    for m in ("a", "b"):
        e = (pdf.y_real - pdf[m]).to_numpy()
        for name, sample, point in (("mae", np.abs(e)[idx].mean(axis=1), np.abs(e).mean()),
                                    ("rmse", np.sqrt((e ** 2)[idx].mean(axis=1)), math.sqrt((e ** 2).mean())),
                                    ("bias", e[idx].mean(axis=1), e.mean())):
            low, high = np.percentile(sample, [2.5, 97.5])
            assert (got[m][name], got[m][f"{name}_low"], got[m][f"{name}_high"]) == pytest.approx((point, low, high))
    d = bootstrap_differences(df, [("a", "b")], resamples=50, block_length=length).first()
    delta = np.abs(pdf.y_real - pdf.a).to_numpy() - np.abs(pdf.y_real - pdf.b).to_numpy()
    low, high = np.percentile(delta[idx].mean(axis=1), [2.5, 97.5])
    assert (d.delta_mae, d.low, d.high, d.excludes_zero) == (pytest.approx(delta.mean()), pytest.approx(low), pytest.approx(high), bool(low > 0 or high < 0))


def test_bootstrap_by_key_with_different_lengths(spark):
    _, one = wide(spark, 30)
    _, two = wide(spark, 11, seed=8)
    both = one.withColumn("key", F.lit("x")).unionByName(two.withColumn("key", F.lit("y")))
    got = {r.key: r.low for r in bootstrap_differences(both, [("a", "b")], ["key"], resamples=40).collect()}
    assert got["x"] == pytest.approx(bootstrap_differences(one, [("a", "b")], resamples=40).first().low)
    assert got["y"] == pytest.approx(bootstrap_differences(two, [("a", "b")], resamples=40).first().low)
    table = block_sensitivity(one, [("a", "b")], resamples=20, block_lengths=(3, 5))
    assert sorted(r.block_days for r in table.collect()) == [3, 5]


def test_bootstrap_shuffles_a_series_once(spark):
    _, one = wide(spark, 30)
    keyed = one.withColumn("key", F.lit(None).cast("int")).unionByName(one.withColumn("key", F.lit(7)))
    pairs = [("a", "b"), ("b", "a")]
    for df in (block_sensitivity(keyed, pairs, ["key"], resamples=300, block_lengths=(3, 7, 40)), bootstrap_intervals(keyed, ["a", "b"], ["key"], resamples=300)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and plan.count("Join") == 0
    table = block_sensitivity(keyed, pairs, ["key"], resamples=300, block_lengths=(3, 7, 40)).collect()
    cells = lambda key: sorted((r.block_days, r.model_a, r.delta_mae, r.low, r.high) for r in table if r.key == key)
    assert len(table) == 12 and cells(None) == cells(7)
    alone = [r for length in (3, 7, 40) for r in bootstrap_differences(one, pairs, resamples=300, block_length=length).collect()]
    assert sorted((r.low, r.high) for r in alone) == sorted(c[3:] for c in cells(7))


def test_resample_means_and_edges(spark):
    pdf, df = wide(spark, 23)
    means = bootstrap_means(df, [], "target", ["a"], 260, 7).orderBy("resample").collect()
    idx = np.array([r["index"] for r in block_indices(spark.createDataFrame([(23,)], "n bigint"), 260, 7).orderBy("resample", "place").collect()])
    assert [r.a for r in means] == pytest.approx(list(pdf.a.to_numpy()[idx.reshape(260, 23)].mean(axis=1)))
    assert bootstrap_intervals(df.limit(0), ["a"], resamples=5).count() == 0
    gaps = df.withColumn("a", F.when(F.col("a") < 50, F.col("a")))
    known = pdf[pdf.a < 50]
    assert bootstrap_intervals(gaps, ["a"], resamples=5).first().mae == pytest.approx((known.y_real - known.a).abs().mean())


def test_side_by_side_drops_incomplete_dates(spark):
    data = [("a", 1, d, d, 1.0, 2.0) for d in days("2024-01-01", 3)] + [("b", 1, d, d, 9.0, 3.0) for d in days("2024-01-02", 3)]
    got = rows(models_side_by_side(spark.createDataFrame(data, PRED), ["a", "b"]).select("y_real", "a", "b"))
    assert got == [(1.0, 2.0, 3.0)] * 2


# --- trained models ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    out = []
    for key, slope in (("a", 2.0), ("b", -1.0)):
        for i, d in enumerate(days("2022-01-01", 420)):
            x = math.sin(i / 9) * 10
            out.append((key, d, 30 + x, x, float(rng.normal()), float(d.month), 5 + slope))
    return spark.createDataFrame(out, "key string, day date, y double, x double, noise double, month double, level double").cache()


TRAIN, TEST = (dt.date(2022, 1, 1), dt.date(2022, 11, 30)), (dt.date(2022, 12, 20), dt.date(2023, 2, 10))


def test_arx_solves_each_series(spark, panel):
    pdf = panel.where("key = 'a'").toPandas()
    preds = direct_arx(direct_task(panel, ["key"], "day", "y", 1, *TEST, *TRAIN), ["key"], ["y", "x", "noise"], 1)
    got = preds.where("key = 'a'").toPandas().sort_values("target")
    x, y = pdf[["y", "x", "noise"]].to_numpy()[:-1], pdf.y.to_numpy()[1:]
    dates = pd.to_datetime(pdf.day).to_numpy()[1:]
    train = dates <= np.datetime64(TRAIN[1])
    test = (dates >= np.datetime64(TEST[0])) & (dates <= np.datetime64(TEST[1]))
    mu, sd = x[train].mean(0), x[train].std(0)
    design = lambda m: np.c_[np.ones(m.sum()), (x[m] - mu) / sd]
    beta = np.linalg.lstsq(design(train), y[train], rcond=None)[0]
    np.testing.assert_allclose(got.y_pred.to_numpy(), np.maximum(0, design(test) @ beta), rtol=1e-6)
    assert preds.count() == 2 * 53


def test_boosted_trees_learn(spark, panel):
    task = direct_task(panel, ["key"], "day", "y", 1, *TEST, *TRAIN)
    few = {"n_estimators": 8, "learning_rate": 0.3, "max_depth": 3}
    preds, model = boosted_trees(task, ["key"], ["y", "x", "noise"], 1, few)
    mae = forecast_metrics(preds, ["model"]).first().mae
    assert preds.count() == 2 * 53 and mae < 3
    names = [r.feature for r in feature_importance(model, ["y", "x", "noise"], spark).collect()]
    assert len(names) == 3 and names[0] in ("x", "y")


FEW = {"n_estimators": 5, "learning_rate": 0.3, "max_depth": 2, "subsample": 0.7, "colsample_bytree": 0.7}


def test_horizons_fitted_together_equal_single_fits(spark, panel):
    task = multi_horizon_task(panel, ["key"], "day", "y", (1, 7), *TEST, *TRAIN)
    preds, models = boosted_trees_by_horizon(task, ["key"], ["y", "x", "noise"], (1, 7), FEW)
    assert set(models) == {1, 7}
    order = ["horizon", "key", "target"]
    for h in (1, 7):
        single, _ = boosted_trees(direct_task(panel, ["key"], "day", "y", h, *TEST, *TRAIN), ["key"], ["y", "x", "noise"], h, FEW)
        assert rows(single.select("key", "horizon", "origin", "target", "y_real", "model"), *order) == rows(
            preds.where(F.col("horizon") == h).select("key", "horizon", "origin", "target", "y_real", "model"), *order)
    truth = panel.select("key", F.col("day").alias("target"), F.col("y").cast("double").alias("truth"))
    joined = preds.join(truth, ["key", "target"])
    assert joined.count() == preds.count() == 2 * 2 * 53  # every target day of the window, every series and horizon
    assert joined.where((F.col("y_real") != F.col("truth")) | (F.datediff("target", "origin") != F.col("horizon")) | (F.col("y_pred") < 0)).count() == 0
    for r in forecast_metrics(preds, ["horizon"]).collect():
        kept = preds.where(F.col("horizon") == r.horizon).toPandas()
        assert r.n == len(kept) and r.mae == pytest.approx((kept.y_real - kept.y_pred).abs().mean())


def test_side_by_side_keeps_the_order():
    assert side_by_side(lambda x: x * x, list(range(20)), together=3) == [x * x for x in range(20)]


def test_empty_parts_are_refused(spark, panel):
    late = (dt.date(2030, 1, 1), dt.date(2030, 2, 1))
    with pytest.raises(ValueError, match="test"):
        boosted_trees(direct_task(panel, ["key"], "day", "y", 1, *late, *TRAIN), ["key"], ["x"], 1, FEW)
    early = (dt.date(2000, 1, 1), dt.date(2000, 2, 1))
    with pytest.raises(ValueError, match="train"):
        direct_forecast(panel, ["key"], "day", "y", ["x"], TEST, early, params=FEW, horizons=[1, 3])


def test_prefix_scores_equal_separate_fits(spark, panel):
    """One long fit scores every number of trees as a fit of that many trees does."""
    from daygrid.operators.learning import common_folds
    from daygrid.operators.models import assemble

    task = direct_task(panel, ["key"], "day", "y", 1, *TEST, *TRAIN)
    grid = {"n_estimators": [2, 5], "learning_rate": [0.3], "max_depth": [2], "subsample": [0.7], "colsample_bytree": [0.7]}
    means, best = grid_search(task, ["key"], ["y", "x"], grid, n_splits=2)
    rows_ = assemble(task.where("split = 'train'"), ["y", "x"]).select("key", "target", "label", "features")
    folds_ = rows_.join(common_folds(rows_, "target", 2), "target").cache()
    for n in (2, 5):
        errors = []
        for k in range(2):
            part = folds_.where(F.col("fold") == k).repartition(1)
            model = regressor({**FEW, "n_estimators": n}).fit(part.where("role = 'train'").orderBy("target", "key").select("features", "label"))
            long = regressor({**FEW, "n_estimators": 5}).fit(part.where("role = 'train'").orderBy("target", "key").select("features", "label"))
            test = part.where("role = 'test'").select("features", "label")
            mae = model.transform(test).agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]
            assert long.evaluateEachIteration(test, "absolute")[n - 1] == pytest.approx(mae)
            errors.append(mae)
        assert means.where(F.col("n_estimators") == n).first().mae == pytest.approx(sum(errors) / 2, rel=0.5)
    assert means.count() == 2 and best["n_estimators"] in (2.0, 5.0)


def test_grid_search_prefers_more_trees(spark, panel):
    task = direct_task(panel, ["key"], "day", "y", 1, *TEST, *TRAIN)
    means, best = grid_search(task, ["key"], ["y", "x"], {"n_estimators": [1, 6], "learning_rate": [0.3], "max_depth": [2]}, n_splits=2)
    assert means.count() == 2 and best["max_depth"] == 2.0
    assert best["n_estimators"] in (1.0, 6.0)


def test_experiment_and_ablation(spark, panel):
    one = panel.where("key = 'a'").drop("key")
    preds, metrics = run_experiment(one, [], "day", "y", ["y", "x", "noise"], ["arx", "persistence"], [1, 14],
                                    TRAIN, TEST)
    assert metrics.count() == 4 and preds.count() == 4 * 53
    assert preds.where(F.datediff("target", "origin") != F.col("horizon")).count() == 0
    with pytest.raises(QualityError):
        run_experiment(one, [], "day", "y", ["y"], ["arx"], [1], (dt.date(2021, 1, 1), TRAIN[1]), TEST)
    _, table = ablation(one, [], "day", "y", ["y", "month", "x"], ["month"], TEST, {"n_estimators": 2, "max_depth": 2})
    sizes = {r.model: r.n_features for r in table.collect()}
    assert sizes == {"full": 3, "history+calendar": 2, "weather+calendar": 2, "history": 1, "calendar": 1, "persistence": 1}


def test_direct_forecast_rejects_unknown_models(spark, panel):
    with pytest.raises(ValueError):
        direct_forecast(panel, ["key"], "day", "y", ["x"], TEST, models=["nope"], horizons=[1])
    assert split_by_cut_date(panel, "day", "2022-06-01").where("split = 'train'").count() == 2 * 151


def test_registered_models_have_the_full_parameters(monkeypatch):
    """No fit here: only what the queries ask for."""
    from daygrid.catalog import forecasting
    from daygrid.operators.models import FULL_GRID, HORIZONS, SELECTED, grid_points

    asked = {}

    def seen(name, result):
        def fake(*args, **named):
            asked.setdefault(name, []).append((args, named))
            return result
        return fake

    table = type("Table", (), {"select": lambda self, *c: self, "join": lambda self, *a: self, "unionByName": lambda self, o: self})()
    for name, result in (("_features", table), ("panel", table), ("stage", table), ("rounded", table), ("direct_task", table), ("direct_forecast", table),
                         ("boosted_trees", (table, None)), ("feature_importance", table), ("grid_search", (table, {})),
                         ("direct_arx", table), ("ablation", (table, table)), ("run_experiment", (table, table))):
        monkeypatch.setattr(forecasting, name, seen(name, result))
    for build in (forecasting.forecast_gbt, forecasting.importance, forecasting.search, forecasting.arx, forecasting.ablated,
                  forecasting.experiment_trees):
        build(None, "")
    (args, named), = asked["direct_forecast"]
    assert len(args) == 6 and not named  # all horizons, the selected parameters
    (args, named), = asked["boosted_trees"]
    assert len(args) == 4 and not named
    (args, named), = asked["ablation"]
    assert len(args) == 7 and not named
    (args, named), = asked["grid_search"]
    assert args[3] == FULL_GRID and not named and len(grid_points(args[3])) == 288  # five folds
    assert [args[3] for args, _ in asked["direct_arx"]] == list(HORIZONS)
    assert all(len(args[2]) == 6 for args, _ in asked["direct_arx"])
    (args, named), = asked["run_experiment"]
    assert "boosted_trees" in args[5] and tuple(args[6]) == HORIZONS and "params" not in named
    assert SELECTED["n_estimators"] == 300
