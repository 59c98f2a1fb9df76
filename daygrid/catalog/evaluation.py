"""Metrics, bands, bootstrap intervals and residual diagnostics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from daygrid.catalog.registry import (
    METRICS, MODELS, PREDICTIONS, SUITE, SUITE_SCOPES, TEST, near_sql, predictions, query, rounded, series, stage, table)
from daygrid.catalog.statistics import _GAMMA_TAIL
from daygrid.operators.bootstrap import (
    block_indices, block_sensitivity, bootstrap_differences, bootstrap_intervals)
from daygrid.operators.evaluate import (
    band_mae, best_by_group, forecast_metrics, monthly_metrics, residual_diagnostics, residual_table, winner_counts)
from daygrid.operators.forecast import moving_average_forecast, persistence, persistence_suite
from daygrid.operators.joins import models_side_by_side
from daygrid.plans.base import daily_target

RESAMPLES = 10_000
PAIRS = list(combinations(MODELS, 2))
BANDS = ((5, 8), ("low", "mid", "high"))


def _suite(spark, sf_dir):
    return persistence_suite(stage(series(spark, sf_dir)), [], "day", "y", SUITE_SCOPES)


def _wide(spark, sf_dir):
    return stage(models_side_by_side(predictions(spark, sf_dir), MODELS))


@query("forecast_metrics", f"WITH {SUITE} SELECT scope, model, CAST(horizon AS BIGINT) AS horizon, {METRICS} FROM suite GROUP BY ALL")
def metrics(spark, sf_dir):
    return rounded(forecast_metrics(_suite(spark, sf_dir), ["scope", "model", "horizon"]))


_MONTHLY = f"""SELECT model, CAST(horizon AS BIGINT) AS horizon, CAST(date_trunc('month', target) AS DATE) AS month, {METRICS},
  {near_sql('avg(y_real - y_pred)')} AS mean_error FROM preds GROUP BY ALL"""


@query("monthly_metrics", f"WITH {PREDICTIONS} {_MONTHLY}")
def by_month(spark, sf_dir):
    return rounded(monthly_metrics(predictions(spark, sf_dir)))


@query("best_by_group", f"""
WITH {PREDICTIONS}, m AS ({_MONTHLY}) SELECT month, horizon, arg_min(model, {{'m': mae, 'n': model}}) AS best_model, min(mae) AS mae
FROM m GROUP BY month, horizon""")
def best(spark, sf_dir):
    monthly = rounded(monthly_metrics(predictions(spark, sf_dir)))
    return best_by_group(monthly, ["month", "horizon"])


@query("winner_counts", f"""
WITH {PREDICTIONS}, m AS ({_MONTHLY}), b AS (SELECT month, horizon, arg_min(model, {{'m': mae, 'n': model}}) AS best_model FROM m GROUP BY ALL)
SELECT horizon, best_model, count(*) AS wins FROM b GROUP BY ALL""")
def winners(spark, sf_dir):
    monthly = rounded(monthly_metrics(predictions(spark, sf_dir)))
    return winner_counts(best_by_group(monthly, ["month", "horizon"]))


@query("band_mae", f"""
WITH {PREDICTIONS}, j AS (SELECT model, abs(s.y - y_pred) AS e, CASE WHEN s.y < 5 THEN 'low' WHEN s.y <= 8 THEN 'mid' ELSE 'high' END AS band
                          FROM preds JOIN series s ON s.day = target)
SELECT band, count(*) FILTER (model = 'persistence') AS days,
  {near_sql("100.0 * count(*) FILTER (model = 'persistence') / sum(count(*) FILTER (model = 'persistence')) OVER ()")} AS percent, """
       + ", ".join(near_sql(f"avg(e) FILTER (model = '{m}')") + f" AS {m}" for m in MODELS) + " FROM j GROUP BY band")
def bands(spark, sf_dir):
    return rounded(band_mae(predictions(spark, sf_dir), stage(series(spark, sf_dir)), MODELS, cuts=BANDS[0], labels=BANDS[1]))


@query("residual_table", f"""
WITH {PREDICTIONS} SELECT model, CAST(horizon AS BIGINT) AS horizon, target, {near_sql('y_real')} AS y_real,
  {near_sql('y_real - y_pred')} AS residual, {near_sql('abs(y_real - y_pred)')} AS abs_error FROM preds""")
def residuals(spark, sf_dir):
    return rounded(residual_table(predictions(spark, sf_dir)))


@query("residual_diagnostics", f"""
WITH {PREDICTIONS}, r AS (SELECT model, target, y_real - y_pred AS v, row_number() OVER (PARTITION BY model ORDER BY target) AS i FROM preds),
b AS (SELECT model, count(v) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS med, stddev_samp(v) AS sd, var_pop(v) * count(v) AS ss FROM r GROUP BY model),
acf AS (SELECT b.model, lag, any_value(n) AS n, sum((x.v - mean) * (z.v - mean)) / any_value(ss) AS acf
        FROM b JOIN r x ON x.model = b.model, range(1, 15) k(lag), r z WHERE z.model = b.model AND z.i = x.i + lag GROUP BY b.model, lag),
lb AS (SELECT model, h, any_value(n) * (any_value(n) + 2.0) * sum(acf * acf / (n - lag)) AS q
       FROM acf, (VALUES (7), (14)) v(h) WHERE lag <= h GROUP BY model, h),
p AS (SELECT model, h, {_GAMMA_TAIL} AS p FROM lb)
SELECT model, n, {near_sql('mean')} AS mean_residual, {near_sql('med')} AS median_residual, {near_sql('sd')} AS std_residual, """
       + ", ".join(near_sql(f"(SELECT acf FROM acf a WHERE a.model = b.model AND lag = {k})") + f" AS acf_{k}" for k in (1, 7, 14)) + ", "
       + ", ".join(near_sql(f"(SELECT p FROM p WHERE p.model = b.model AND h = {k})") + f" AS ljung_box_p_{k}" for k in (7, 14)) + " FROM b")
def diagnostics(spark, sf_dir):
    return rounded(residual_diagnostics(predictions(spark, sf_dir), ("model",)))


@query("residual_diagnostics_by_horizon", f"""
WITH {SUITE}, r AS (SELECT horizon, target, y_real - y_pred AS v, row_number() OVER (PARTITION BY horizon ORDER BY target) AS i
                    FROM suite WHERE scope = 'common_352'),
b AS (SELECT horizon, count(v) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS med, stddev_samp(v) AS sd, var_pop(v) * count(v) AS ss FROM r GROUP BY 1),
acf AS (SELECT b.horizon, lag, any_value(n) AS n, sum((x.v - mean) * (z.v - mean)) / any_value(ss) AS acf
        FROM b JOIN r x ON x.horizon = b.horizon, range(1, 15) k(lag), r z WHERE z.horizon = b.horizon AND z.i = x.i + lag GROUP BY b.horizon, lag),
lb AS (SELECT horizon, h, any_value(n) * (any_value(n) + 2.0) * sum(acf * acf / (n - lag)) AS q
       FROM acf, (VALUES (7), (14)) v(h) WHERE lag <= h GROUP BY horizon, h),
p AS (SELECT horizon, h, {_GAMMA_TAIL} AS p FROM lb)
SELECT 'persistence' AS model, CAST(horizon AS BIGINT) AS horizon, n, {near_sql('mean')} AS mean_residual, {near_sql('med')} AS median_residual,
  {near_sql('sd')} AS std_residual, """
       + ", ".join(near_sql(f"(SELECT acf FROM acf a WHERE a.horizon = b.horizon AND lag = {k})") + f" AS acf_{k}" for k in (1, 7, 14)) + ", "
       + ", ".join(near_sql(f"(SELECT p FROM p WHERE p.horizon = b.horizon AND h = {k})") + f" AS ljung_box_p_{k}" for k in (7, 14)) + " FROM b")
def diagnostics_by_horizon(spark, sf_dir):
    """Four horizons over one window, each a series of its own."""
    suite = persistence_suite(stage(series(spark, sf_dir)), [], "day", "y", SUITE_SCOPES)
    return rounded(residual_diagnostics(suite.where("scope = 'common_352'")))


# --- bootstrap --------------------------------------------------------------------------------


def _starts_sql(length: int) -> str:
    """Block starts and sizes from the same digest the operator uses."""
    return f"""(SELECT r, ('0x' || substr(md5(concat_ws(':', 42, r, j)), 1, 12))::BIGINT % n AS s, least({length}, n - j * {length}) AS size
  FROM (SELECT count(*) AS n FROM wide), range({RESAMPLES}) t(r), range(1000) u(j) WHERE j * {length} < n)"""


_WIDE = PREDICTIONS + """,
wide AS (SELECT target, max(y_real) FILTER (model = 'persistence') AS y_real, """ + ", ".join(
    f"max(y_pred) FILTER (model = '{m}') AS {m}" for m in MODELS) + """ FROM preds GROUP BY target),
placed AS (SELECT *, row_number() OVER (ORDER BY target) - 1 AS pos, count(*) OVER () AS n FROM wide),
ring AS (SELECT pos, * EXCLUDE (pos) FROM placed UNION ALL SELECT pos + n, * EXCLUDE (pos) FROM placed)"""


def _prefix(names: dict[str, str]) -> str:
    return "prefix AS (SELECT pos, any_value(n) OVER () AS n, " + ", ".join(
        f"coalesce(sum({e}) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {k}"
        for k, e in names.items()) + " FROM ring)"


def _means(names, length: int, name: str) -> str:
    return f"{name} AS (SELECT r, " + ", ".join(f"sum(z.{k} - a.{k}) / any_value(a.n) AS {k}" for k in names) + \
        f" FROM {_starts_sql(length)} b JOIN prefix a ON a.pos = s JOIN prefix z ON z.pos = s + size GROUP BY r)"


_ERRORS = {f"{kind}{i}": form.format(e=f"(y_real - {m})") for i, m in enumerate(MODELS)
           for kind, form in (("abs", "abs({e})"), ("sq", "{e} * {e}"), ("res", "{e}"))}


def _interval_columns(i: int) -> str:
    parts = []
    for kind, value, point in (("mae", f"abs{i}", f"avg(abs(y_real - {MODELS[i]}))"),
                               ("rmse", f"sqrt(sq{i})", f"sqrt(avg((y_real - {MODELS[i]}) * (y_real - {MODELS[i]})))"),
                               ("bias", f"res{i}", f"avg(y_real - {MODELS[i]})")):
        parts.append(near_sql(f"(SELECT {point} FROM wide)") + f" AS {kind}")
        parts += [near_sql(f"quantile_cont({value}, {p})") + f" AS {kind}_{side}" for side, p in (("low", 0.025), ("high", 0.975))]
    return ", ".join(parts)


@query("block_bootstrap_intervals", f"WITH {_WIDE}, {_prefix(_ERRORS)}, {_means(_ERRORS, 7, 'means')} " + " UNION ALL ".join(
    f"SELECT '{m}' AS model, (SELECT count(*) FROM wide) AS n, {_interval_columns(i)} FROM means" for i, m in enumerate(MODELS)))
def intervals(spark, sf_dir):
    return rounded(bootstrap_intervals(_wide(spark, sf_dir), MODELS, resamples=RESAMPLES))


_DELTAS = {f"d{i}": f"abs(y_real - {a}) - abs(y_real - {b})" for i, (a, b) in enumerate(PAIRS)}


def _delta_rows(source: str, extra: str = "") -> str:
    return " UNION ALL ".join(f"""SELECT '{a}' AS model_a, '{b}' AS model_b, {near_sql(f"(SELECT avg({_DELTAS[f'd{i}']}) FROM wide)")} AS delta_mae,
  {near_sql(f'quantile_cont(d{i}, 0.025)')} AS low, {near_sql(f'quantile_cont(d{i}, 0.975)')} AS high,
  quantile_cont(d{i}, 0.025) > 0 OR quantile_cont(d{i}, 0.975) < 0 AS excludes_zero{extra} FROM {source}""" for i, (a, b) in enumerate(PAIRS))


@query("block_bootstrap_differences", f"WITH {_WIDE}, {_prefix(_DELTAS)}, {_means(_DELTAS, 7, 'means')} {_delta_rows('means')}")
def differences(spark, sf_dir):
    return rounded(bootstrap_differences(_wide(spark, sf_dir), PAIRS, resamples=RESAMPLES))


@query("block_sensitivity", f"WITH {_WIDE}, {_prefix(_DELTAS)}, " + ", ".join(
    _means(_DELTAS, n, f"means{n}") for n in (7, 14, 30)) + " " + " UNION ALL ".join(
    _delta_rows(f"means{n}", f", CAST({n} AS BIGINT) AS block_days") for n in (7, 14, 30)))
def sensitivity(spark, sf_dir):
    return rounded(block_sensitivity(_wide(spark, sf_dir), PAIRS, resamples=RESAMPLES))


_NATION_MEANS = ", ".join(f"""m{length} AS (SELECT a.nation, r, sum(z.d - a.d) / any_value(a.n) AS d
  FROM (SELECT n, r, ('0x' || substr(md5(concat_ws(':', 42, r, j)), 1, 12))::BIGINT % n AS s, least({length}, n - j * {length}) AS size
        FROM (SELECT DISTINCT n FROM placed), range({RESAMPLES}) t(r), range(1000) u(j) WHERE j * {length} < n) b
  JOIN prefix a ON a.n = b.n AND a.pos = s JOIN prefix z ON z.nation = a.nation AND z.pos = s + size GROUP BY ALL)""" for length in (7, 30))


@query("block_sensitivity_by_nation", f"""
WITH counts AS (SELECT c_nationkey AS nation, CAST(o_orderdate AS DATE) AS day, count(*) AS c
                FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
cal AS (SELECT nation, CAST(d AS DATE) AS day FROM (SELECT DISTINCT nation FROM counts),
        (SELECT unnest(generate_series((SELECT min(day) FROM counts), (SELECT max(day) FROM counts), INTERVAL 1 DAY)) AS d)),
daily AS (SELECT nation, day, coalesce(c, 0) AS y FROM cal LEFT JOIN counts USING (nation, day)),
models AS (SELECT nation, day AS target, y, lag(y) OVER (PARTITION BY nation ORDER BY day) AS a,
                  avg(y) OVER (PARTITION BY nation ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS b FROM daily),
loss AS (SELECT nation, target, abs(y - a) - abs(y - b) AS d FROM models
         WHERE target BETWEEN DATE '{TEST[0]}' - CAST(nation AS INTEGER) AND DATE '{TEST[1]}'),
placed AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY target) - 1 AS pos, count(*) OVER (PARTITION BY nation) AS n FROM loss),
ring AS (SELECT * FROM placed UNION ALL SELECT * REPLACE (pos + n AS pos) FROM placed),
prefix AS (SELECT nation, n, pos, coalesce(sum(d) OVER (PARTITION BY nation ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM ring),
point AS (SELECT nation, avg(d) AS delta FROM loss GROUP BY 1), {_NATION_MEANS}
""" + " UNION ALL ".join(f"""SELECT CAST(nation AS BIGINT) AS nation, 'persistence' AS model_a, 'mean_7d' AS model_b, CAST({length} AS BIGINT) AS block_days,
  {near_sql('any_value(delta)')} AS delta_mae, {near_sql('quantile_cont(d, 0.025)')} AS low, {near_sql('quantile_cont(d, 0.975)')} AS high,
  quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS excludes_zero FROM m{length} JOIN point USING (nation) GROUP BY nation""" for length in (7, 30)))
def sensitivity_by_nation(spark, sf_dir):
    """One series per nation, each with a test window (and so a ring) of another length."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    events = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.col("o_orderdate").alias("start"))
    daily = stage(daily_target(events, ["nation"]))
    long = persistence(daily, ["nation"], "day", "y").unionByName(moving_average_forecast(daily, ["nation"], "day", "y", 7))
    cut = long.where(f"target BETWEEN date_sub(DATE '{TEST[0]}', int(nation)) AND DATE '{TEST[1]}'")
    wide = models_side_by_side(cut, ["persistence", "mean_7d"], ["nation"])
    return rounded(block_sensitivity(wide, [("persistence", "mean_7d")], ["nation"], resamples=RESAMPLES, block_lengths=(7, 30)))


@query("block_indices", f"""
WITH {_WIDE} SELECT r AS resample, CAST(sum(pos) AS BIGINT) AS index_sum, count(*) AS n FROM (
  SELECT b.r, (b.s + o) % (SELECT count(*) FROM wide) AS pos FROM {_starts_sql(7)} b, range(7) q(o) WHERE o < size) GROUP BY r""")
def indices(spark, sf_dir):
    """The resampled positions of the test year, summed per resample."""
    lengths = _wide(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    return rounded(block_indices(lengths, RESAMPLES, 7).groupBy("resample").agg(
        F.sum("index").alias("index_sum"), F.count(F.lit(1)).alias("n")))
