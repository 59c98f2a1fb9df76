"""Violations, guards and sources."""

import datetime as dt
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from conftest import days, rows
from daygrid.operators.calendar import complete_calendar, expected_row_count, reindex_calendar
from daygrid.operators.quality import (
    QualityError, apply_domain_rules, fitted_leakage, as_integer_target, check_experiment, check_outputs, conflicting_duplicates,
    date_gaps, dedup_events, drop_conflicts, duplicate_keys, integer_target, invalid_keys, null_counts, numeric_columns,
    numeric_target, prediction_coverage, read_sentinel, require, require_columns, require_non_empty, require_one_to_one,
    same_dates_across_models)
from daygrid.plans.base import clean_hourly, daily_base, daily_target, daily_weather
from daygrid.plans.experiment import recut_experiment
from daygrid.sources.files import files_by_header, fingerprint_files, select_station_files, source_manifest
from daygrid.sources.readers import (
    check_daily_base, load_multi_horizon_results, scan_drop_malformed, scan_events_csv, scan_hourly_csv, scan_parquet,
    unique_events)
from daygrid.operators.learning import fitted_rows
from daygrid.sources.sinks import append_run, check_stored, expected_predictions, missing_from, read_runs, write_outputs

HOURLY = "day date, hour string, rain double, temp double, wind_dir double, gust double, wind_speed double"
D1 = dt.date(2024, 1, 1)


def test_require_columns_lists_missing(spark):
    with pytest.raises(QualityError, match=r"\['a', 'z'\]"):
        require_columns(spark.range(1), ["z", "id", "a"])


def test_identical_hours_collapse(spark):
    df = spark.createDataFrame([(D1, "00", 1.0, 20.0, 0.0, 5.0, 2.0), (D1, "00", 1.0, 20.0, 0.0, 5.0, 2.0),
                                (D1, "01", 2.0, 22.0, 0.0, 6.0, 4.0)], HOURLY)
    r = daily_weather(clean_hourly(df, []), []).first()
    assert (r.n_records, r.rain, r.speed_mean, r.dir_sin, r.dir_cos) == (2, 3.0, 3.0, 0.0, 1.0)


def test_conflicting_hours_are_refused(spark):
    df = spark.createDataFrame([(D1, "00", 1.0, 20.0, 0.0, 5.0, 2.0), (D1, "00", 1.0, 25.0, 0.0, 5.0, 2.0)], HOURLY)
    with pytest.raises(QualityError, match="conflicting"):
        clean_hourly(df, [])


def test_null_is_a_value_of_its_own(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (2, None), (2, None), (3, 1.0)], "k int, v double")
    assert rows(conflicting_duplicates(df, ["k"], ["v"])) == [(1, 2)]
    assert rows(drop_conflicts(df, ["k"], ["v"]), "k") == [(2, None), (3, 1.0)]


def test_domain_rules(spark):
    df = spark.createDataFrame([(D1, "00", -1.0, -9999.0, 361.0, -2.0, 0.0), (D1, "01", 0.0, -5.0, 360.0, 300.0, -0.1)], HOURLY)
    got = rows(apply_domain_rules(df, ["rain", "temp", "wind_dir", "gust", "wind_speed"], ["rain", "gust", "wind_speed"],
                                  {"wind_dir": (0.0, 360.0)}).drop("day"), "hour")
    assert got == [("00", None, None, None, None, 0.0), ("01", 0.0, -5.0, 360.0, 300.0, None)]
    assert rows(read_sentinel(spark.createDataFrame([(-9999.0,), (-999.0,)], "v double"), ["v"]), "v") == [(None,), (-999.0,)]


def test_opposite_directions_in_a_day(spark):
    df = spark.createDataFrame([(D1, "00", 0.0, 1.0, 0.0, 1.0, 1.0), (D1, "01", 0.0, 1.0, 180.0, 1.0, 1.0)], HOURLY)
    r = daily_weather(clean_hourly(df, []), []).first()
    assert r.dir_sin is None and r.dir_cos is None and r.dir_angle is None


def test_dedup_keeps_earliest(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", 5, "w")], "id string, ts int, p string")
    assert rows(dedup_events(df, ["id"], "ts", ["p"]), "id") == [("a", 1, "y"), ("b", 5, "w")]
    assert rows(dedup_events(df, ["id"], "ts"), "id") == [("a", 1), ("b", 5)]


def test_daily_target_counts_and_fills(spark):
    df = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 23:59:59"), ("c", "2024-01-03 00:00:00")], "id string, s string")
    got = rows(daily_target(df.select("id", F.col("s").cast("timestamp_ntz").alias("start")), [], "2024-01-01", "2024-01-04"), "day")
    assert [g[1] for g in got] == [2, 0, 1, 0]


def test_calendar_bounds(spark):
    df = spark.createDataFrame([("a", D1, 1), ("a", dt.date(2024, 1, 3), 2), ("b", dt.date(2024, 1, 2), 3)], "k string, day date, y int")
    assert complete_calendar(df, ["k"], "day", {"y": 0}).count() == 6
    assert complete_calendar(df, ["k"], "day", {"y": 0}, bounds="per_key").count() == 4
    assert rows(reindex_calendar(df, ["k"], "day"), "k", "day")[1] == ("a", dt.date(2024, 1, 2), None)
    assert rows(expected_row_count(df, ["k"], "day")) == [("a", 2, 3)]
    far = spark.createDataFrame([("a", D1, 1), ("a", dt.date(2060, 1, 1), 2)], "k string, day date, y int")
    filled = reindex_calendar(far, ["k"], "day")
    assert filled.count() == (dt.date(2060, 1, 1) - D1).days + 1 == filled.select("day").distinct().count()
    assert filled.where("y is not null").count() == 2
    assert complete_calendar(df.limit(0), ["k"], "day").count() == 0
    assert complete_calendar(df.drop("k").limit(0), [], "day").count() == 0


def test_date_gaps_across_blocks(spark):
    df = spark.createDataFrame([("a", D1), ("a", dt.date(2024, 1, 2)), ("a", dt.date(2060, 1, 1)), ("b", D1)], "k string, day date")
    assert rows(date_gaps(df, ["k"], "day")) == [("a", dt.date(2024, 1, 2), dt.date(2060, 1, 1), (dt.date(2060, 1, 1) - dt.date(2024, 1, 2)).days - 1)]


def test_counting_rules(spark):
    df = spark.createDataFrame([(1, float("nan"), "x"), (1, None, None), (2, 1.0, "3")], "k int, v double, s string")
    assert dict(rows(null_counts(df, ["k", "v", "s"]))) == {"k": 0, "v": 2, "s": 1}
    assert rows(duplicate_keys(df, ["k"])) == [(1, 2)]
    assert numeric_columns(df) == ["k", "v"]
    assert numeric_target(df, "s").count() == 2
    assert invalid_keys(spark.createDataFrame([("a", "2024-01-01"), (None, "2024-01-01"), ("b", "oops")], "id string, t string"),
                        ["id"], ["t"]).count() == 2
    with pytest.raises(QualityError):
        require_one_to_one(df, df, ["k"])
    with pytest.raises(QualityError):
        require_non_empty(df.limit(0))
    require(df.limit(0), "never")


def test_integer_target(spark):
    df = spark.createDataFrame([(10.0,), (10.0 + 1e-9,)], "y double")
    assert rows(as_integer_target(df, "y")) == [(10,), (10,)]
    with pytest.raises(QualityError):
        as_integer_target(spark.createDataFrame([(10.5,)], "y double"), "y")
    assert integer_target(spark.createDataFrame([(None,)], "y double"), "y").count() == 1


def preds(spark, shift_b=0, n=3):
    data = [(m, 1, d - dt.timedelta(days=1), d, 1.0, 2.0) for m, s in (("a", 0), ("b", shift_b))
            for d in days("2024-01-0%d" % (1 + s), n)]
    return spark.createDataFrame(data, "model string, horizon int, origin date, target date, y_real double, y_pred double")


def test_date_sets_differ(spark):
    assert same_dates_across_models(preds(spark), ["a", "b"]).count() == 0
    assert same_dates_across_models(preds(spark, 1), ["a", "b"]).count() == 2


def test_coverage(spark):
    got = {r.model: r.ok for r in prediction_coverage(preds(spark, 1), ["a", "b", "c"], [1], "2024-01-01", "2024-01-03", "2024-01-01").collect()}
    assert got == {"a": True, "b": False, "c": False}
    extra = prediction_coverage(preds(spark), ["a"], [1], "2024-01-01", "2024-01-03", "2024-01-01")
    assert {r.model: r.expected for r in extra.collect()} == {"a": True, "b": False}


D = dt.date
GOOD = dict(models=["arx"], horizons=[1], train=(D(2023, 1, 1), D(2023, 12, 31)), test=(D(2024, 1, 14), D(2024, 3, 1)))


@pytest.mark.parametrize("change", [
    {"models": []}, {"horizons": []}, {"models": ["x"]}, {"horizons": [2]},
    {"train": (D(2023, 12, 31), D(2023, 1, 1))}, {"test": (D(2024, 3, 1), D(2024, 1, 14))},
    {"test": (D(2023, 12, 31), D(2024, 3, 1))}, {"horizons": [1, 14], "test": (D(2024, 1, 13), D(2024, 3, 1))},
    {"train": (D(2023, 10, 1), D(2023, 12, 31))}, {"test": (D(2024, 1, 14), D(2024, 1, 15))}])
def test_experiment_rules(change):
    check_experiment(**GOOD, known_models=("arx",))
    check_experiment(**(GOOD | {"horizons": [14]}), known_models=("arx",))
    with pytest.raises(QualityError):
        check_experiment(**(GOOD | change), known_models=("arx",))


def test_outputs(spark):
    full = spark.range(1)
    with pytest.raises(QualityError, match="empty products: \\['b'\\]"):
        check_outputs({"a": full, "b": full.limit(0)}, ["a", "b"])
    with pytest.raises(QualityError, match="missing products: \\['c'\\]"):
        check_outputs({"a": full}, ["a", "c"])
    check_outputs({"a": full, "b": full}, ["a", "b"])


# --- files --------------------------------------------------------------------------------------


def test_event_and_hourly_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,extra,begin\n007,x,2024-01-01 10:00:00\n007,y,2024-01-01 09:00:00\n8,z,2024-01-05 00:00:00\n")
    events = scan_events_csv(spark, [str(tmp_path / "e.csv")], "id", "begin")
    got = rows(unique_events(events, "2024-01-01", "2024-01-04"))
    assert got == [("007", dt.datetime(2024, 1, 1, 9))]
    (tmp_path / "bad.csv").write_text("id,begin\n1,never\n")
    with pytest.raises(QualityError):
        unique_events(scan_events_csv(spark, [str(tmp_path / "bad.csv")], "id", "begin"), "2024-01-01", "2024-01-04")
    (tmp_path / "h.csv").write_text("data,hora,t,junk\n2024-01-01,0000,20.5,1\n2024-01-01,0100,oops,2\n2024-01-01,0200,-9999,2\n")
    hourly = scan_hourly_csv(spark, [str(tmp_path / "h.csv")], {"t": "temp"}, "data", "hora", sentinel=-9999.0)
    assert rows(hourly, "hour") == [(D1, "0000", 20.5), (D1, "0100", None), (D1, "0200", None)]


def test_malformed_lines_are_skipped(spark, tmp_path):
    (tmp_path / "b.csv").write_text("a,b,c,d,e,f,g,h\n07522669000192,m,f,i,d,2024,1,10.5\n075,m,f,i,d,2024,x,1,9\n1,m,f,i,d,2024,2,3\n")
    got = rows(scan_drop_malformed(spark, [str(tmp_path / "b.csv")]).select("tax_id", "month", "value"), "month")
    assert got == [("07522669000192", 1, 10.5), ("1", 2, 3.0)]


def test_nan_becomes_null(spark, tmp_path):
    spark.createDataFrame([(1, float("nan")), (2, 3.0)], "k int, v double").write.parquet(str(tmp_path / "t"))
    assert rows(scan_parquet(spark, str(tmp_path / "t")), "k") == [(1, None), (2, 3.0)]
    assert rows(scan_parquet(spark, str(tmp_path / "t"), ["k"], "k = 2")) == [(2,)]


def test_station_files(spark, tmp_path):
    for folder, name in (("2020", "S_01-01-2020_A_x.CSV"), ("2021", "S_01-01-2021_A_x.CSV"), ("2020", "S_01-01-2021_A_y.CSV")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text("x")
    pattern = r"_\d{2}-\d{2}-(20\d{2})_A_"
    paths = select_station_files(spark, str(tmp_path), "S_*.CSV", pattern, [2020, 2021])
    assert [p.split("/")[-2] for p in paths] == ["2020", "2021"]
    (tmp_path / "2021" / "S_02-02-2021_A_z.CSV").write_text("x")
    with pytest.raises(QualityError, match=r"missing years \[2022\]; repeated years \[2021\]"):
        select_station_files(spark, str(tmp_path), "S_*.CSV", pattern, [2020, 2021, 2022])


def test_fingerprints_and_manifest(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"hello")
    files = fingerprint_files(spark, str(tmp_path))
    assert rows(files) == [("f.bin", 5, hashlib.sha256(b"hello").hexdigest())]
    for part in ("a b", "c"):  # one name in two folders, longer than a block
        (tmp_path / part).mkdir()
        (tmp_path / part / "part-0").write_bytes(part.encode() * 5000)
    assert rows(fingerprint_files(spark, str(tmp_path), "part-*", block=1000), "file") == [
        (f"{p}/part-0", len(p) * 5000, hashlib.sha256(p.encode() * 5000).hexdigest()) for p in ("a b", "c")]
    daily = spark.createDataFrame([(D1, 2), (dt.date(2024, 1, 2), 0)], "day date, y bigint")
    files = fingerprint_files(spark, str(tmp_path))  # a listing is as old as its table
    summary, listed = source_manifest(daily, "y", "day", spark.range(3).agg(F.count("*")), files, "events per day", "r7")
    doc = summary.first()
    assert doc["raw_rows"] == 3 and doc["zero_days"] == 1 and doc["start"] == D1 and doc["run_id"] == "r7"
    assert doc["files"] == listed.count() == 3 and doc["bytes"] == 5 + 4 * 5000
    assert rows(listed, "file")[-1] == ("r7", "f.bin", 5, hashlib.sha256(b"hello").hexdigest())


def test_digests_are_of_the_stored_bytes(spark, tmp_path):
    """A compressed file is not unpacked first."""
    data = gzip.compress(b"hello" * 100)
    (tmp_path / "a.csv.gz").write_bytes(data)
    assert rows(fingerprint_files(spark, str(tmp_path))) == [("a.csv.gz", len(data), hashlib.sha256(data).hexdigest())]


def test_files_with_one_header_are_one_scan(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"h{i}.csv").write_text("data,hora,t\n" f"2024-01-0{i + 1},00,{i}.5\n")
    (tmp_path / "odd [1] {x}.csv").write_text("\r\n t,hora,data\r\n9.5,00,2024-01-08\r\n".replace(" t", "t"))
    (tmp_path / "packed.csv.gz").write_bytes(gzip.compress(b"t,hora,data\n8.5,00,2024-01-09\n"))
    (tmp_path / "empty.csv").write_text("")
    assert sorted(len(g) for g in files_by_header(spark, [str(tmp_path)], block=3)) == [2, 6]
    hourly = scan_hourly_csv(spark, [str(tmp_path)], {"t": "temp"}, "data", "hora")
    assert [r[2] for r in rows(hourly, "day")] == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 9.5, 8.5]
    assert hourly._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2


def test_stored_products_are_checked(spark, tmp_path):
    full = spark.createDataFrame([(1,)], "k int")
    write_outputs({"a": full, "b": full.limit(0)}, str(tmp_path))
    check_stored(spark, str(tmp_path), ["a"])
    with pytest.raises(QualityError, match=r"missing products: \['c'\]; empty products: \['b'\]"):
        check_stored(spark, str(tmp_path), ["a", "b", "c"])


def test_loaded_results_are_complete(spark, tmp_path):
    """Every pair on every day once, nothing else; each way to break it is an error."""
    cells = [(m, h, D1 + dt.timedelta(d - h), D1 + dt.timedelta(d), 1.0, 2.0) for m in "ab" for h in (1, 3) for d in range(4)]
    kind = "model string, horizon int, origin date, target date, y_real double, y_pred double"
    last = D1 + dt.timedelta(3)
    metrics = spark.createDataFrame([("a", 1.0)], "model string, mae double")

    def load(found, models=("a", "b"), end=last):
        folder = str(tmp_path / str(load.calls))
        load.calls += 1
        write_outputs({"predictions": spark.createDataFrame(found, kind), "metrics": metrics}, folder)
        return load_multi_horizon_results(spark, folder, models, (1, 3), (D1, end))[1].count()

    load.calls = 0
    assert load(cells) == 16
    changed = lambda i, value: [*cells[:3], (*cells[3][:i], value, *cells[3][i + 1:]), *cells[4:]]
    broken = {
        "missing values": changed(5, None), "twice": [*cells, cells[0]], "outside": changed(3, dt.date(2030, 1, 1)),
        "predictions missing": cells[1:], "not expected": [*cells, ("c", *cells[0][1:])], "wrong date": changed(2, D1)}
    for message, found in broken.items():
        with pytest.raises(QualityError, match=message):
            load(found)
    with pytest.raises(QualityError):
        load(cells, models=("a", "b", "d"))
    part, errors = recut_experiment(spark.createDataFrame(cells, kind), [], ["a", "b"], [1, 3], D1 + dt.timedelta(1), last)
    assert part.count() == 12 and {r.n for r in errors.collect()} == {3}
    with pytest.raises(QualityError, match="predictions missing"):
        recut_experiment(spark.createDataFrame(cells, kind), [], ["a", "b"], [1, 3], D1, last + dt.timedelta(1))


def test_runs_are_never_overwritten(spark, tmp_path):
    p = preds(spark)
    m = spark.createDataFrame([("a", 1.0)], "model string, mae double")
    run = append_run(p, m, {"seed": 1}, str(tmp_path), "r1")
    append_run(p, m, {"seed": 2}, str(tmp_path))
    assert run == "r1" and read_runs(spark, str(tmp_path), "metrics").select("run_id").distinct().count() == 2
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        append_run(p, m, {}, str(tmp_path), "r1")
    write_outputs({"metrics": m, "predictions": p}, str(tmp_path / "out"), {"predictions": ["model"]})
    metrics, back = load_multi_horizon_results(spark, str(tmp_path / "out"))
    assert metrics.count() == 1 and back.count() == 6


def test_broken_runs_stay_invisible(spark, tmp_path):
    """A run whose stored rows miss one of the contract has no marker, so nobody reads it."""
    p = preds(spark)
    m = spark.createDataFrame([(r.model, r.horizon, 1.0) for r in p.select("model", "horizon").distinct().collect()], "model string, horizon int, mae double")
    whole = p.select("model", "horizon", "target")
    run = append_run(p, m, {}, str(tmp_path), "good", whole)
    late = whole.withColumn("target", F.date_add("target", 400))
    for broken, metrics, contract in ((p.limit(1), m, whole), (p, m, late), (p, m.limit(0), whole)):
        with pytest.raises(QualityError, match="stored"):
            append_run(broken, metrics, {}, str(tmp_path), expected=contract)
    for name in ("predictions", "metrics", "contract"):
        assert {r.run_id for r in read_runs(spark, str(tmp_path), name).collect()} == {run}
    grid = expected_predictions(spark, ["a", "b"], [1, 7], "2024-01-01", "2024-01-03", spark.createDataFrame([("x",), (None,), ("x",)], "k string"))
    assert grid.count() == 2 * 2 * 2 * 3 and grid.columns == ["k", "model", "horizon", "target"]
    assert missing_from(grid, grid).count() == 0 and missing_from(grid.where("k = 'x'"), grid).count() == 12


def test_statistics_fitted_on_other_rows_are_found(spark):
    days_ = spark.createDataFrame([(k, dt.date(2024, 1, 1 + i), float(i)) for k in ("a", None) for i in range(20)], "k string, day date, y double")
    split = days_.withColumn("split", F.when(F.col("y") < 15, "train").otherwise("test"))
    fitted = fitted_rows(split, ["k"], "day")
    assert fitted_leakage(fitted, split, ["k"]).count() == 0 == fitted_leakage(fitted_rows(split, [], "day"), split).count()
    everything = fitted_rows(split.withColumn("split", F.lit("train")), ["k"], "day")
    assert fitted_leakage(everything, split, ["k"]).count() == 2 and fitted_leakage(fitted.where("k = 'a'"), split, ["k"]).count() == 1
    assert fitted_leakage(fitted.withColumn("rows", F.col("rows") - 1), split, ["k"]).count() == 2
    assert fitted_leakage(fitted, split.withColumn("split", F.lit("test")), ["k"]).count() == 2


def test_daily_base_checks(spark):
    target = spark.createDataFrame([(D1, 1), (dt.date(2024, 1, 2), 2)], "day date, y bigint")
    weather = spark.createDataFrame([(D1, 3.0, 1.0)], "day date, rain double, dir_angle double")
    joined = daily_base(target, weather, [])
    assert rows(joined, "day") == [(D1, 1, 3.0), (dt.date(2024, 1, 2), 2, None)]
    check_daily_base(joined, [], "day", ["y", "rain"])
    with pytest.raises(QualityError):
        check_daily_base(joined.union(joined), [], "day", ["y"])
