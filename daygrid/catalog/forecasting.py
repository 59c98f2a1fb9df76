"""Splits, scalers, baselines and trained models."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from daygrid.catalog.registry import (
    COMMON_TEST, METRICS, MODELS as BASELINES, PANEL, PREDICTIONS, SERIES, SPARSE, SUITE, SUITE_SCOPES, TEST, base, near_sql, panel, predictions,
    query, rounded, series, sparse, stage)
from daygrid.catalog.timeseries import COMPLETE, FEATURE_CTES
from daygrid.operators.blocks import join_keys
from daygrid.operators.evaluate import forecast_metrics, metrics_by_split
from daygrid.operators.forecast import (
    baseline_table, moving_average_forecast, persistence, persistence_suite, recut_predictions)
from daygrid.operators.learning import (
    direct_task, fitted_rows, minmax_inverse, minmax_scale, split_by_cut_date, split_by_fraction, split_by_target_date,
    split_last_rows, standardize, time_series_folds, zscore)
from daygrid.operators.models import (
    FULL_GRID, HORIZONS, ablation, boosted_trees, direct_arx, direct_forecast, feature_importance, grid_search)
from daygrid.operators.quality import QualityError, fitted_leakage
from daygrid.operators.windows import lead_target
from daygrid.plans.experiment import MODELS, recut_experiment, run_experiment
from daygrid.plans.features import CALENDAR, LINEAR_FEATURES, build_features, feature_columns
from daygrid.sources.readers import load_multi_horizon_results
from daygrid.sources.sinks import append_run, read_runs, write_outputs
from daygrid.stage import checkpoint_root

CUT = "2000-01-01"

_NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM panel)"


@query("split_by_fraction", f"""
WITH {PANEL}, {_NUMBERED} SELECT key, day, y, CASE WHEN i < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM n""")
def by_fraction(spark, sf_dir):
    return split_by_fraction(stage(panel(spark, sf_dir)), ["key"], "day", 0.8)


@query("split_last_rows", f"""
WITH {PANEL}, {_NUMBERED} SELECT key, day, y, CASE WHEN i >= n - 365 THEN 'test' ELSE 'train' END AS split FROM n""")
def last_rows(spark, sf_dir):
    return split_last_rows(stage(panel(spark, sf_dir)), ["key"], "day", 365)


@query("split_by_target_date", f"""
WITH {PANEL}, l AS (SELECT key, day, y, lead(y, 14) OVER (PARTITION BY key ORDER BY day) AS label, day + 14 AS target FROM panel)
SELECT *, CASE WHEN target < DATE '{TEST[0]}' THEN 'train' ELSE 'test' END AS split FROM l
WHERE label IS NOT NULL AND target <= DATE '{TEST[1]}'""")
def by_target(spark, sf_dir):
    task = lead_target(panel(spark, sf_dir), ["key"], "day", "y", 14)
    return split_by_target_date(task, *TEST).select("key", "day", "y", "label", "target", "split")


@query("split_by_cut_date", f"""
WITH {SERIES} SELECT CASE WHEN day < DATE '{CUT}' THEN 'train' ELSE 'test' END AS split, count(*) AS n,
  CAST(sum(y) AS BIGINT) AS y FROM series GROUP BY 1""")
def by_cut(spark, sf_dir):
    return split_by_cut_date(series(spark, sf_dir), "day", CUT).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))


_CUT_SPLIT = f"s AS (SELECT *, CASE WHEN day < DATE '{CUT}' THEN 'train' ELSE 'test' END AS split FROM panel)"


@query("minmax_train_only", f"""
WITH {PANEL}, {_CUT_SPLIT}, m AS (SELECT key, min(y) AS lo, max(y) AS hi FROM s WHERE split = 'train' GROUP BY key)
SELECT key, day, split, {near_sql('(y - lo) / CAST(CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS DOUBLE)')} AS y FROM s JOIN m USING (key)""")
def minmax(spark, sf_dir):
    rows = stage(split_by_cut_date(panel(spark, sf_dir), "day", CUT))
    return rounded(minmax_scale(rows, ["key"], ["y"]))


@query("minmax_inverse", f"WITH {PANEL} SELECT key, day, {near_sql('y')} AS y FROM panel")
def minmax_back(spark, sf_dir):
    rows = stage(split_by_cut_date(panel(spark, sf_dir), "day", CUT))
    return rounded(minmax_inverse(minmax_scale(rows, ["key"], ["y"], keep_stats=True), ["y"]).select("key", "day", "y"))


@query("standardize_train_only", f"""
WITH {PANEL}, {_CUT_SPLIT}, m AS (SELECT key, avg(y) AS m, stddev_pop(y) AS sd FROM s WHERE split = 'train' GROUP BY key)
SELECT key, day, split, {near_sql('(y - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END')} AS y FROM s JOIN m USING (key)""")
def standardized(spark, sf_dir):
    return rounded(standardize(stage(split_by_cut_date(panel(spark, sf_dir), "day", CUT)), ["key"], ["y"]))


@query("zscore_train_only", f"""
WITH {SPARSE}, s AS (SELECT *, CASE WHEN day < DATE '{CUT}' THEN 'train' ELSE 'test' END AS split FROM sparse),
m AS (SELECT avg(y) AS my, avg(rain) AS mr, stddev_samp(y) AS sy, stddev_samp(rain) AS sr FROM s WHERE split = 'train')
SELECT day, split, {near_sql('(y - my) / coalesce(nullif(sy, 0), 1)')} AS y,
       {near_sql('(rain - mr) / coalesce(nullif(sr, 0), 1)')} AS rain FROM s, m""")
def zscored(spark, sf_dir):
    rows = split_by_cut_date(sparse(spark, sf_dir).drop("temp"), "day", CUT)
    return rounded(zscore(rows, [], ["y", "rain"]))


@query("time_series_folds", f"""
WITH {PANEL}, {_NUMBERED}, f AS (SELECT *, fold, n // 6 AS size, n - (5 - fold) * (n // 6) AS start FROM n, range(5) t(fold))
SELECT fold, key, CASE WHEN i < start THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(day) AS first_day, max(day) AS last_day
FROM f WHERE i < start + size GROUP BY ALL""")
def folds(spark, sf_dir):
    return time_series_folds(stage(panel(spark, sf_dir)), ["key"], "day").groupBy("fold", "key", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


# --- baselines ------------------------------------------------------------------------------


@query("persistence", f"""
WITH {PANEL} SELECT t.key, 'persistence' AS model, CAST(3 AS BIGINT) AS horizon, t.day - 3 AS origin, t.day AS target,
  {near_sql('t.y')} AS y_real, {near_sql('o.y')} AS y_pred
FROM panel t JOIN panel o ON o.key = t.key AND o.day = t.day - 3""")
def persist(spark, sf_dir):
    return rounded(persistence(stage(panel(spark, sf_dir)), ["key"], "day", "y", 3))


@query("persistence_suite", f"""
WITH {SUITE} SELECT scope, model, CAST(horizon AS BIGINT) AS horizon, origin, target, {near_sql('y_real')} AS y_real,
  {near_sql('y_pred')} AS y_pred FROM suite""")
def suite(spark, sf_dir):
    return rounded(persistence_suite(stage(series(spark, sf_dir)), [], "day", "y", SUITE_SCOPES))


@query("moving_average_forecast", f"""
WITH {PANEL}, f AS (SELECT key, day, y, avg(y) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS p FROM panel)
SELECT key, 'mean_7d' AS model, CAST(1 AS BIGINT) AS horizon, day - 1 AS origin, day AS target, {near_sql('y')} AS y_real,
  {near_sql('p')} AS y_pred FROM f""")
def moving_average(spark, sf_dir):
    return rounded(moving_average_forecast(panel(spark, sf_dir), ["key"], "day", "y"))


_BASELINES = f"""{PANEL}, b AS (SELECT key, day, y, lag(y) OVER (PARTITION BY key ORDER BY day) AS persistence,
  avg(y) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean_7d,
  row_number() OVER (PARTITION BY key ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM panel),
t AS (SELECT *, CASE WHEN i < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM b)"""


@query("metrics_by_split", f"WITH {_BASELINES} " + " UNION ALL ".join(f"""
SELECT key, '{m}' AS model, split, {near_sql(f'avg(abs({m} - y))')} AS mae,
  {near_sql(f'sqrt(avg(({m} - y) * ({m} - y)))')} AS rmse, count({m}) AS n FROM t GROUP BY key, split""" for m in ("persistence", "mean_7d")))
def by_split(spark, sf_dir):
    rows = baseline_table(stage(panel(spark, sf_dir)), ["key"], "day", "y")
    return rounded(metrics_by_split(rows, "y", ["persistence", "mean_7d"], ["key"]))


@query("recut_predictions", f"""
WITH {PREDICTIONS} SELECT model, count(*) AS n, min(target) AS first_target, max(target) AS last_target,
  {near_sql('avg(abs(y_real - y_pred))')} AS mae FROM preds WHERE target BETWEEN DATE '2000-09-01' AND DATE '2000-12-31' GROUP BY model""")
def recut(spark, sf_dir):
    rows = recut_predictions(predictions(spark, sf_dir), "2000-09-01", "2000-12-31")
    return rounded(rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.min("target").alias("first_target"), F.max("target").alias("last_target"),
        F.avg(F.abs(F.col("y_real") - F.col("y_pred"))).alias("mae")))


@query("load_multi_horizon_results", f"""
WITH {SUITE}, common AS (SELECT * FROM suite WHERE scope = 'common_352'),
errors AS (SELECT model, horizon, {METRICS} FROM common GROUP BY ALL)
SELECT model, CAST(horizon AS BIGINT) AS horizon, origin, target, y_real, y_pred, n, mae FROM common JOIN errors USING (model, horizon)""")
def multi_horizon_results(spark, sf_dir):
    """Predictions of four horizons and their metrics are stored, read back and held against pairs and period."""
    folder = f"{checkpoint_root(spark)}/results-{uuid.uuid4().hex}"
    suite = persistence_suite(stage(series(spark, sf_dir)), [], "day", "y", SUITE_SCOPES)
    preds = stage(suite.where("scope = 'common_352'").drop("scope"))
    write_outputs({"predictions": preds, "metrics": forecast_metrics(preds, ["model", "horizon"])}, folder, {"predictions": ["horizon"]})
    metrics, back = load_multi_horizon_results(spark, folder, ["persistence"], HORIZONS, COMMON_TEST)
    found = back.join(metrics.select("model", "horizon", "n", "mae"), ["model", "horizon"])
    return rounded(found.select("model", "horizon", "origin", "target", "y_real", "y_pred", "n", "mae"))


@query("recut_experiment", f"""
WITH {PREDICTIONS} SELECT model, CAST(horizon AS BIGINT) AS horizon, {METRICS} FROM preds
WHERE target BETWEEN DATE '2000-09-01' AND DATE '2000-12-31' GROUP BY ALL""")
def recut_metrics(spark, sf_dir):
    """A new test period: complete there, evaluated anew, nothing refitted."""
    return rounded(recut_experiment(predictions(spark, sf_dir), [], BASELINES, [1], "2000-09-01", "2000-12-31")[1])


# --- trained models (checked by tests, not by SQL) -----------------------------------------------


def _features(spark, sf_dir):
    return stage(build_features(base(spark, sf_dir), []))


@query("direct_forecast_gbt")
def forecast_gbt(spark, sf_dir):
    return direct_forecast(_features(spark, sf_dir), [], "day", "y", feature_columns(), TEST)


@query("feature_importance")
def importance(spark, sf_dir):
    task = direct_task(_features(spark, sf_dir), [], "day", "y", 1, *TEST)
    _, model = boosted_trees(task, [], feature_columns(), 1)
    return feature_importance(model, feature_columns(), spark)


# Not registered: 144 fits of 500 trees by five folds take hours on a few cores (README has the figures).
def search(spark, sf_dir):
    task = direct_task(_features(spark, sf_dir), [], "day", "y", 1, *TEST)
    means, _ = grid_search(task, [], feature_columns(), FULL_GRID)
    return means


def _solved_sql(train: str) -> str:
    """Least squares of the six covariates in SQL: normal equations of standardised columns, solved by elimination."""
    names, size = LINEAR_FEATURES, len(LINEAR_FEATURES) + 1
    columns = lambda text: ", ".join(text.format(c=c, i=i) for i, c in enumerate(names))
    steps, width = [], size + 1
    for p in range(1, size + 1):
        steps.append(f"""q{p} AS (SELECT key, h, list_transform(r, lambda x: x / r[{p}]) AS r FROM m{p - 1} WHERE i = {p}),
m{p} AS (SELECT m.key, m.h, m.i, CASE WHEN m.i = {p} THEN q.r
  ELSE [{", ".join(f"m.r[{j}] - m.r[{p}] * q.r[{j}]" for j in range(1, width + 1))}] END AS r FROM m{p - 1} m JOIN q{p} q USING (key, h))""")
    sums = ", ".join([f"sum(v[i] * v[{j}])" for j in range(1, size + 1)] + ["sum(v[i] * label)"])
    return f"""
days AS (SELECT p.key, p.day, {columns("CAST({c} AS DOUBLE) AS x{i}").replace("CAST(y AS", "CAST(p.y AS")}, CAST(p.y AS DOUBLE) AS y0
         FROM panel p JOIN (SELECT * FROM shifted JOIN emas USING (day) WHERE {COMPLETE}) f USING (day)),
task AS ({" UNION ALL ".join(f"SELECT *, {h} AS h, day + {h} AS target, lead(y0, {h}) OVER (PARTITION BY key ORDER BY day) AS label FROM days" for h in HORIZONS)}),
known AS (SELECT *, CASE WHEN {train} THEN 'train' WHEN target BETWEEN DATE '{TEST[0]}' AND DATE '{TEST[1]}' THEN 'test' END AS split
          FROM task WHERE label IS NOT NULL),
scale AS (SELECT key, h, {columns("avg(x{i}) AS a{i}, stddev_pop(x{i}) AS s{i}")} FROM known WHERE split = 'train' GROUP BY ALL),
z AS (SELECT k.key, k.h, day, target, label, split, [CAST(1 AS DOUBLE), {columns("(x{i} - a{i}) / CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END")}] AS v
      FROM known k JOIN scale USING (key, h) WHERE split IS NOT NULL),
m0 AS (SELECT key, h, i, [{sums}] AS r FROM z, range(1, {size + 1}) t(i) WHERE split = 'train' GROUP BY key, h, i),
{", ".join(steps)},
weights AS (SELECT key, h, list(r[{width}] ORDER BY i) AS b FROM m{size} GROUP BY ALL)"""


@query("direct_arx", f"""
WITH RECURSIVE {FEATURE_CTES}, {PANEL}, {_solved_sql(f"target < DATE '{TEST[0]}'")}
SELECT key, 'arx' AS model, CAST(h AS BIGINT) AS horizon, day AS origin, target, {near_sql('label', 2)} AS y_real,
  {near_sql('greatest(0, ' + ' + '.join(f'v[{j}] * b[{j}]' for j in range(1, len(LINEAR_FEATURES) + 2)) + ')', 2)} AS y_pred
FROM z JOIN weights USING (key, h) WHERE split = 'test'""")
def arx(spark, sf_dir):
    """One linear model per priority on its own history, the weather and the calendar."""
    shared = _features(spark, sf_dir).select("day", *[c for c in LINEAR_FEATURES if c != "y"])
    days = stage(panel(spark, sf_dir).join(shared, "day"))
    out = None
    for h in HORIZONS:
        part = direct_arx(direct_task(days, ["key"], "day", "y", h, *TEST), ["key"], LINEAR_FEATURES, h)
        out = part if out is None else out.unionByName(part)
    return rounded(out, 2)  # the solvers differ by some 1e-8: more digits would meet a tie


def _line_sql(source: str, key: str, train: str) -> str:
    """Test predictions of a straight line from y[t] to y[t+h], fitted on the training targets."""
    k = f"{key}, " if key else ""
    part = f"PARTITION BY {key} " if key else ""
    using = f"USING (horizon{', ' + key if key else ''})"
    return f"""
task AS ({" UNION ALL ".join(f"SELECT {k}{h} AS horizon, day AS origin, day + {h} AS target, CAST(y AS DOUBLE) AS x, CAST(lead(y, {h}) OVER ({part}ORDER BY day) AS DOUBLE) AS label FROM {source}" for h in (1, 3, 7, 14))}),
fit AS (SELECT {k}horizon, regr_slope(label, x) AS a, regr_intercept(label, x) AS b FROM task
        WHERE label IS NOT NULL AND {train} GROUP BY ALL),
line AS (SELECT {k}horizon, origin, target, label AS y_real, greatest(0, a * x + b) AS y_pred FROM task JOIN fit {using}
         WHERE label IS NOT NULL AND target BETWEEN DATE '{TEST[0]}' AND DATE '{TEST[1]}')"""


@query("direct_arx_one_covariate", f"""
WITH {PANEL}, {_line_sql('panel', 'key', f"target < DATE '{TEST[0]}'")}
SELECT key, 'arx' AS model, CAST(horizon AS BIGINT) AS horizon, origin, target, {near_sql('y_real')} AS y_real,
  {near_sql('y_pred')} AS y_pred FROM line""")
def arx_one(spark, sf_dir):
    """With one covariate the model is a straight line per series, which SQL can fit too."""
    days = stage(panel(spark, sf_dir))
    return rounded(direct_forecast(days, ["key"], "day", "y", ["y"], TEST, models=["arx"]))


@query("ablation")
def ablated(spark, sf_dir):
    _, metrics = ablation(_features(spark, sf_dir), [], "day", "y", feature_columns(), CALENDAR, TEST)
    return metrics


@query("run_experiment", f"""
WITH {SERIES}, {_line_sql('series', '', "target BETWEEN DATE '1996-01-01' AND DATE '2000-07-01'")},
both_models AS (SELECT 'arx' AS model, horizon, y_real, y_pred FROM line
  UNION ALL SELECT 'persistence', horizon, y_real, CAST(s.y AS DOUBLE) FROM line JOIN series s ON s.day = origin)
SELECT model, CAST(horizon AS BIGINT) AS horizon, {METRICS} FROM both_models GROUP BY ALL""")
def experiment(spark, sf_dir):
    """Validation, two models, four horizons, metrics."""
    _, metrics = run_experiment(
        stage(series(spark, sf_dir)), [], "day", "y", ["y"], ["arx", "persistence"], [1, 3, 7, 14],
        (date(1996, 1, 1), date(2000, 7, 1)), (date(2000, 8, 1), date(2001, 7, 31)))
    return rounded(metrics)


@query("stored_experiment", f"""
WITH {SERIES}, {_line_sql('series', '', "target BETWEEN DATE '1996-01-01' AND DATE '2000-07-01'")},
both_models AS (SELECT 'arx' AS model, horizon, target, y_real, y_pred FROM line
  UNION ALL SELECT 'persistence', horizon, line.target, y_real, CAST(s.y AS DOUBLE) FROM line JOIN series s ON s.day = origin)
SELECT 'whole' AS run_id, model, CAST(horizon AS BIGINT) AS horizon, min(target) AS first_target, max(target) AS last_target,
  (SELECT count(*) FROM range(DATE '2000-08-01', DATE '2001-08-01', INTERVAL 1 DAY)) AS expected, {METRICS} FROM both_models GROUP BY ALL""")
def stored(spark, sf_dir):
    """Two runs go to a store, one of them without half of its days; what is read back is the other."""
    folder = f"{checkpoint_root(spark)}/daygrid/runs-{uuid.uuid4().hex}"
    preds, metrics = run_experiment(
        stage(series(spark, sf_dir)), [], "day", "y", ["y"], ["arx", "persistence"], [1, 3, 7, 14],
        (date(1996, 1, 1), date(2000, 7, 1)), (date(2000, 8, 1), date(2001, 7, 31)), folder=folder, run_id="whole")
    contract = read_runs(spark, folder, "contract").drop("run_id")
    try:
        append_run(preds.where("month(target) < 7"), metrics, {}, folder, "broken", contract)
    except QualityError:
        pass  # no marker was written, so nobody sees this run
    by = ["run_id", "model", "horizon"]
    found = read_runs(spark, folder, "predictions").groupBy(*by).agg(F.min("target").alias("first_target"), F.max("target").alias("last_target"))
    wanted = read_runs(spark, folder, "contract").groupBy(*by).agg(F.count(F.lit(1)).alias("expected"))
    return rounded(found.join(wanted, by).join(read_runs(spark, folder, "metrics"), by))


@query("fitted_statistics", f"""
WITH {PANEL}, {_CUT_SPLIT}, f AS (SELECT key, min(day) AS first_day, max(day) AS last_day, count(*) AS rows FROM s WHERE split = 'train' GROUP BY key)
SELECT *, FALSE AS leaks FROM f UNION ALL
SELECT key, min(day), max(day), count(*), TRUE FROM s GROUP BY key""")
def fitted(spark, sf_dir):
    """What a scaler was fitted on, by series, for one fitted on the training rows and one on all rows, and whether it leaks."""
    rows = stage(split_by_cut_date(panel(spark, sf_dir), "day", CUT))
    out = None
    for source in (rows, rows.withColumn("split", F.lit("train"))):
        found = fitted_rows(source, ["key"], "day")
        leaks = fitted_leakage(found, rows, ["key"]).select("key", F.lit(True).alias("_leaks"))
        part = join_keys(found, leaks, ["key"], how="left").withColumn("leaks", F.coalesce("_leaks", F.lit(False))).drop("_leaks")
        out = part if out is None else out.unionByName(part)
    return out


@query("run_experiment_trees")
def experiment_trees(spark, sf_dir):
    """All three models on the feature table, at all horizons."""
    _, metrics = run_experiment(
        _features(spark, sf_dir), [], "day", "y", feature_columns(), MODELS, HORIZONS,
        (date(1996, 1, 1), date(2000, 7, 1)), (date(2000, 8, 1), date(2001, 7, 31)), arx_features=LINEAR_FEATURES)
    return metrics
