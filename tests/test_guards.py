"""Rules checked by the write of a result, and rows that fail the job that reads them."""

import datetime as dt

import pytest
from conftest import days
from pyspark.sql import functions as F

from daygrid.operators.quality import Guard, QualityError, collapse_versions, conflicting_duplicates
from daygrid.plans.base import clean_hourly, daily_target, daily_weather
from daygrid.plans.features import READINGS, build_features
from daygrid.sources.readers import unique_events
from daygrid.stage import session_folder, stage

HOURLY = "k string, day date, hour string, rain double, temp double, wind_dir double, gust double, wind_speed double"
EVENTS = "event_id string, start timestamp_ntz"
D = dt.date(2024, 1, 1)


def hours(spark, *rows):
    return spark.createDataFrame([(*r, 1.0, 90.0, 2.0, 3.0) for r in rows], HOURLY)


def test_raw_tables_are_shuffled_once(spark):
    guard = Guard()
    daily = daily_weather(clean_hourly(hours(spark, ("a", D, "00", 1.0)), ["k"], guard), ["k"])
    plan = daily._jdf.queryExecution().executedPlan().toString()
    # Once by hour, where copies combine first, and once the sums by day.
    assert plan.count("Exchange ") == 2 and plan.count("hashpartitioning(k#") == 2 and plan.count("Scan") == 1
    events = unique_events(spark.createDataFrame([("x", dt.datetime(2024, 1, 1))], EVENTS), "2024-01-01", "2024-01-02", Guard())
    assert events._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_a_write_passes_or_names_what_is_wrong(spark):
    good = hours(spark, ("a", D, "00", 1.0), ("a", D, "00", 1.0), ("a", D, "01", 2.0), ("b", D, "00", None), ("b", D, "00", None))
    guard = Guard()
    stored = guard.stage(daily_weather(clean_hourly(good, ["k"], guard), ["k"]))
    assert sorted((r["k"], r["rain"], r["n_records"]) for r in stored.collect()) == [("a", 3.0, 2), ("b", None, 1)]
    for extra, message in (((("a", D, "01", 5.0),), "conflicting copies of an hour; rows=1"), ((("a", D, "01", None),), "conflicting"),
                           ((("a", None, "00", 1.0),), "null day or hour; rows=1"), (((None, D, "00", 1.0),), "null day or hour")):
        guard = Guard()
        bad = daily_weather(clean_hourly(good.unionByName(hours(spark, *extra)), ["k"], guard), ["k"])
        with pytest.raises(QualityError, match=message):
            guard.stage(bad)
        with pytest.raises(QualityError, match="conflicting"):
            clean_hourly(good.unionByName(hours(spark, *extra)), ["k"])


def test_events(spark):
    at = dt.datetime(2024, 1, 1, 5)
    for rows, message in (([("a", at), ("a", None)], "unreadable starts; rows=1"), ([(None, at)], "null event ids"), ([], "no records")):
        guard = Guard()
        events = unique_events(spark.createDataFrame(rows, EVENTS), "2024-01-01", "2024-12-31", guard)
        with pytest.raises(QualityError, match=message):
            guard.stage(events)
    guard = Guard()
    rows = [("a", at), ("a", at), ("b", dt.datetime(2023, 1, 1))]
    assert [tuple(r) for r in guard.stage(unique_events(spark.createDataFrame(rows, EVENTS), "2024-01-01", "2024-12-31", guard)).collect()] == [("a", at)]


def test_empty_hours_pass(spark):
    guard = Guard()
    assert guard.stage(daily_weather(clean_hourly(hours(spark, ("a", D, "00", 1.0)).limit(0), ["k"], guard), ["k"])).count() == 0


def test_conflicts_are_those_of_the_rule(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, 2.0, 1.0), (2, None, None), (2, None, None), (3, 1.0, 2.0), (3, 1.0, 3.0), (None, 1.0, 1.0)],
                               "k int, v double, w double")
    flagged = collapse_versions(df, ["k"], ["v", "w"])
    assert sorted(r["k"] for r in flagged.where("_conflict").collect()) == sorted(r["k"] for r in conflicting_duplicates(df, ["k"], ["v", "w"]).collect()) == [1, 3]
    assert {(r["k"], r["v"], r["w"]) for r in flagged.where("NOT _conflict").collect()} == {(2, None, None), (None, 1.0, 1.0)}


def feature_input(spark, n=40, **change):
    rows = [("a", d, float(i % 5), *[1.0 + (i * j) % 7 for j in range(1, len(READINGS) + 1)]) for i, d in enumerate(days("2024-01-01", n))]
    df = spark.createDataFrame(rows, "k string, day date, y double, " + ", ".join(f"{c} double" for c in READINGS))
    return df.withColumns({c: F.expr(e) for c, e in change.items()})


@pytest.mark.parametrize("change,message", [
    ({"y": "if(day = '2024-01-20', null, y)"}, "y is missing"),
    ({"gust": "cast(null as double)"}, "gust is missing after interpolation"),
    ({"dir_sin": "if(day = '2024-01-20', 0D, dir_sin)", "dir_cos": "if(day = '2024-01-20', 0D, dir_cos)"}, "direction undefined.*2024-01-20"),
])
def test_features_refuse_bad_rows(spark, change, message):
    with pytest.raises(Exception, match=message):
        build_features(feature_input(spark, **change), ["k"]).collect()


def test_features_have_no_gaps(spark):
    table = build_features(feature_input(spark, rain="if(day > '2024-01-10', null, rain)").where("day <> '2024-02-09'"), ["k"])
    got = sorted(r["day"] for r in table.collect())
    assert got == days("2024-01-08", 32)
    with pytest.raises(Exception, match="y is missing"):  # a day the base lacks has no target
        build_features(feature_input(spark).where("day <> '2024-01-20'"), ["k"]).collect()


def test_stored_tables_lie_in_the_folder_of_their_session(spark):
    """One folder holds all of a session's tables, so it can be removed by name."""
    folder = session_folder(spark)
    assert folder.endswith(f"/daygrid/{spark.sparkContext.applicationId}")
    table = stage(spark.range(3))
    assert table.count() == 3 and all(folder in name for name in table.inputFiles())
