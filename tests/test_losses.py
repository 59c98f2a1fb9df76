"""Rows that must not be lost or moved silently: null keys, gaps, constant groups, other column orders."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from daygrid.operators.blocks import attach, attach_spread
from daygrid.operators.calendar import complete_calendar
from daygrid.operators.distribution import density
from daygrid.operators.evaluate import residual_diagnostics
from daygrid.operators.learning import common_folds, direct_task
from daygrid.operators.models import direct_arx, search_and_refit
from daygrid.operators import association, distribution, evaluate, forecast, joins, ranks, windows
from daygrid.operators.quality import QualityError, experiment_violations, no_leakage, prediction_coverage, target_covers_predictions
from daygrid.operators.windows import ema, lead_target, sequence_windows
from daygrid.sources.readers import scan_drop_malformed, scan_events_csv, scan_hourly_csv, unique_events

from conftest import days, rows


def day(n):
    return dt.date(2024, 1, n)


@pytest.mark.parametrize("bounds", ["global", "per_key"])
def test_null_keys_keep_their_counts(spark, bounds):
    df = spark.createDataFrame([(None, day(1), 5), (None, day(3), 7), ("a", day(1), 1), ("a", day(3), 2)], "k string, day date, y bigint")
    out = complete_calendar(df, ["k"], "day", {"y": 0}, bounds=bounds)
    assert [r["y"] for r in out.where("k IS NULL").orderBy("day").collect()] == [5, 0, 7]
    assert [r["y"] for r in out.where("k = 'a'").orderBy("day").collect()] == [1, 0, 2]


def test_null_keys_get_their_statistics(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), (None, 3)], "k string, v int")
    stats = df.groupBy("k").agg(F.sum("v").alias("s"))
    for out in (attach(df, stats, ["k"]), attach_spread(df, stats, ["k"], "v")):
        assert sorted(tuple(r) for r in out.select("v", "s").collect()) == [(1, 4), (2, 2), (3, 4)]


def test_labels_follow_the_date_over_a_gap(spark):
    df = spark.createDataFrame([(day(n), float(n)) for n in (1, 2, 3, 4, 6, 7, 8)], "day date, y double")
    got = {r["day"].day: (r["target"].day, r["label"]) for r in lead_target(df, [], "day", "y", 3).collect()}
    assert got == {1: (4, 4.0), 3: (6, 6.0), 4: (7, 7.0)}
    windows = sequence_windows(df, [], "day", ["y"], "y", length=2, horizon=1).collect()
    assert sorted((r["origin"].day, r["target"].day, r["label"]) for r in windows) == [(2, 3, 3.0), (3, 4, 4.0), (7, 8, 8.0)]


def test_constant_groups_stay_in_the_density(spark):
    df = spark.createDataFrame([("c", 2.0), ("c", 2.0), ("v", 1.0), ("v", 3.0)], "k string, x double")
    out = density(df, "x", 10, ["k"])
    flat = out.where("k = 'c'").collect()
    assert len(flat) == 10 and all(r["x"] == 2.0 and r["density"] is None for r in flat)
    assert out.where("k = 'v' AND density > 0").count() == 10


def test_files_with_other_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("d,h,t,r\n2024-01-01,0,20,1\n")
    (tmp_path / "b.csv").write_text("r,t,h,d\n2,30,0,2024-01-02\n")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv")]
    out = scan_hourly_csv(spark, paths, {"t": "temp", "r": "rain"}, "d", "h")
    assert rows(out.select("day", "temp", "rain"), "day") == [(day(1), 20.0, 1.0), (day(2), 30.0, 2.0)]
    (tmp_path / "e1.csv").write_text("id,at\nx,2024-01-01\n")
    (tmp_path / "e2.csv").write_text("at,id\n2024-01-02,y\n")
    events = scan_events_csv(spark, [str(tmp_path / n) for n in ("e1.csv", "e2.csv")], "id", "at")
    assert sorted(r["event_id"] for r in events.collect()) == ["x", "y"]


def test_skipped_lines_do_not_depend_on_the_columns_read(spark, tmp_path):
    (tmp_path / "b.csv").write_text("tax_id,modality,flow,item,detail,year,month,value\n"
                                    "01,m,f,i,d,2024,1,2.5\n02,m,f,i,d,odd,1,2.5\n03,m,f,i,d,2024,2,3.5\n")
    out = scan_drop_malformed(spark, [str(tmp_path / "b.csv")])
    assert out.count() == 2 == len(out.collect()) == out.select("tax_id").count()
    assert [r["tax_id"] for r in out.select("tax_id").orderBy("tax_id").collect()] == ["01", "03"]


def test_a_good_copy_does_not_hide_an_unreadable_one(spark):
    events = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("a", None)], "event_id string, start timestamp_ntz")
    with pytest.raises(QualityError):
        unique_events(events, "2024-01-01", "2024-12-31")


def test_diagnostics_keep_horizons_apart(spark):
    df = spark.createDataFrame([("m", h, day(1) + dt.timedelta(days=i), float(i * h % 7), 0.0) for h in (1, 3) for i in range(40)],
                               "model string, horizon int, target date, y_real double, y_pred double")
    one = residual_diagnostics(df.where("horizon = 1")).first()
    both = {r["horizon"]: r for r in residual_diagnostics(df).collect()}
    assert set(both) == {1, 3} and both[1] == one


def test_leakage_reports_groups_with_one_part(spark):
    train = spark.createDataFrame([(1, day(5)), (2, day(5))], "horizon int, target date")
    test = spark.createDataFrame([(1, day(6)), (3, day(6))], "horizon int, origin date")
    assert sorted(r["horizon"] for r in no_leakage(train, test).collect()) == [2, 3]


def test_linear_model_skips_incomplete_rows_as_a_whole(spark):
    data = [(d, float(i), None if i % 5 == 0 else 2.0 * i, 3.0 * i + 1) for i, d in enumerate(days("2024-01-01", 60))]
    df = spark.createDataFrame(data, "day date, a double, b double, y double")
    out = direct_arx(direct_task(df, [], "day", "y", 1, "2024-02-10", "2024-02-20"), [], ["a", "b"], 1).collect()
    assert out and all(r["y_pred"] == pytest.approx(r["y_real"]) for r in out)


def test_all_violations_are_named():
    found = experiment_violations([], [2], (day(10), day(20)), (day(15), day(16)), ("arx",))
    assert len(found) == 5 and "no model" in found


def test_folds_of_a_pooled_model_share_their_dates(spark):
    data = [(k, d, float(i)) for k, start in (("a", "2024-01-01"), ("b", "2024-03-01")) for i, d in enumerate(days(start, 60))]
    df = spark.createDataFrame(data, "k string, day date, y double")
    folds = df.join(common_folds(df, "day", 3), "day").groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("day"))).alias("last"), F.min(F.when(F.col("role") == "test", F.col("day"))).alias("first"))
    assert folds.count() == 3 and folds.where("last >= first").count() == 0


def test_search_refits_on_all_training_rows(spark):
    df = spark.createDataFrame([(d, float(i % 7), float(i % 7) * 2) for i, d in enumerate(days("2024-01-01", 90))], "day date, x double, y double")
    task = direct_task(df, [], "day", "y", 1, "2024-03-20", "2024-03-30")
    scores, preds, model = search_and_refit(task, [], ["x"], 1, {"n_estimators": [1, 4], "learning_rate": [0.5], "max_depth": [3]}, 2)
    assert scores.count() == 2 and preds.count() == 11 and model.getNumTrees == 4


def test_averages_refuse_missing_values(spark):
    df = spark.createDataFrame([(day(1), 1.0), (day(2), None), (day(3), 2.0)], "day date, y double")
    with pytest.raises(Exception, match="missing values"):
        ema(df, [], "day", ["y"], [3]).collect()


# --- a null key is a series like any other -----------------------------------------------------


@pytest.fixture(scope="module")
def keyed(spark):
    """Two equal series of 40 days, one under "a", one under a null key, with extra payload."""
    values = [float((7 * i * i + 3 * i) % 23) for i in range(40)]
    return spark.createDataFrame(
        [(k, d, v, float(i % 5)) for k in ("a", None) for i, (d, v) in enumerate(zip(days("2024-01-01", 40), values))],
        "k string, day date, y double, x double")


def alike(df):
    """The null key has rows, and they are those of "a"."""
    cols = [c for c in df.columns if c != "k"]
    short = lambda v: round(v, 9) if isinstance(v, float) else v
    null, known = (sorted((tuple(map(short, r)) for r in df.where(which).select(*cols).collect()), key=str) for which in ("k IS NULL", "k = 'a'"))
    assert null == known and null


def forecasts(keyed):
    from daygrid.operators.forecast import moving_average_forecast, persistence

    return persistence(keyed, ["k"], "day", "y", 2).unionByName(moving_average_forecast(keyed, ["k"], "day", "y", 3))


NULL_KEY_CASES = {
    "left_by_day": lambda d: joins.left_by_day(d.select("k", "day", "y"), d.select("k", "day", "x"), ["k"]),
    "inner_by_day": lambda d: joins.inner_by_day(d.select("k", "day", "y"), d.select("k", "day", "x"), ["k"]),
    "inner_by_month": lambda d: joins.inner_by_month(*[d.groupBy("k", F.trunc("day", "MM").alias("month")).agg(F.sum(c).alias(c)) for c in "yx"], ["k"]),
    "left_align": lambda d: joins.left_align(d.select("k", "day", "y"), [d.select("k", "day", "x")], ["k", "day"]),
    "at_offset": lambda d: joins.at_offset(d, ["k"], "day", "y", 3),
    "persistence_suite": lambda d: forecast.persistence_suite(d, ["k"], "day", "y", [("all", 2, "2024-01-10", "2024-02-05")]),
    "persistence": lambda d: forecast.persistence(d, ["k"], "day", "y", 3),
    "box_stats": lambda d: distribution.box_stats(d, ["k"], "y"),
    "fliers": lambda d: distribution.fliers(d.unionByName(d.limit(0)).withColumn("y", F.when(F.col("x") == 0, F.col("y") * 90).otherwise(F.col("y"))), ["k"], "y"),
    "histogram": lambda d: distribution.histogram(d, "y", 5, ["k"]),
    "center": lambda d: distribution.center(d, "y", ["k"]),
    "density": lambda d: distribution.density(d, "y", 10, ["k"]),
    "decompose_additive": lambda d: windows.decompose_additive(d, ["k"], "day", "y", 7),
    "quantiles": lambda d: ranks.quantiles(d, ["k"], "y", {"q": 0.3}),
    "spearman_matrix": lambda d: association.spearman_matrix(d, ["y", "x"], ["k"]),
    "kendall_matrix": lambda d: association.kendall_matrix(d, ["y", "x"], ["k"]),
    "band_mae": lambda d: evaluate.band_mae(forecasts(d).where("model = 'persistence'"), d, ["persistence"], ["k"], cuts=(5, 12)),
    "residual_diagnostics": lambda d: evaluate.residual_diagnostics(forecasts(d), ["k", "model", "horizon"]),
    "models_side_by_side": lambda d: joins.models_side_by_side(forecasts(d).where("target > '2024-01-03'"), ["persistence", "mean_3d"], ["k"]),
}


@pytest.mark.parametrize("name", sorted(NULL_KEY_CASES))
def test_null_keys_in_every_panel_operator(spark, keyed, name):
    alike(NULL_KEY_CASES[name](keyed))


def test_null_keys_in_checks(spark, keyed):
    preds = forecasts(keyed).where("model = 'persistence'")
    assert target_covers_predictions(preds, keyed, ["k"]).count() == 0
    seen = prediction_coverage(preds, ["persistence"], [2], "2024-01-03", "2024-02-09", "2024-01-01", ["k"])
    assert seen.count() == 2 and seen.where("ok").count() == 2
    part = preds.withColumn("horizon", F.lit(2))
    assert no_leakage(part.where("target < '2024-01-20'"), part.where("origin >= '2024-01-20'"), ["k"]).count() == 0
    assert joins.missing_offsets(keyed, ["k"], "day", 1, "2024-01-02", "2024-02-09").count() == 0
