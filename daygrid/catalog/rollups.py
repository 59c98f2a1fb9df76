"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.catalog.registry import (
    BASE, PANEL, PREDICTIONS, READINGS, SPARSE, SUITE, SUITE_SCOPES, TEST, base, near, near_sql, panel,
    predictions, query, readings, rounded, series, sparse, stage, table)
from daygrid.operators.distribution import box_stats, center, density, fliers, histogram
from daygrid.operators.evaluate import band_quartiles, forecast_metrics, pivot_metric
from daygrid.operators.forecast import persistence_suite
from daygrid.operators.rollup import (
    Measure, circular_mean, circular_reaggregate, daily_distinct_count, daily_measures, multi_scale, period_summary,
    resample, resample_legacy, yearly_stats)
from daygrid.operators.shape import monthly_balance
from daygrid.plans.base import ROLLUP, WEATHER

_WEEK_MON = "CAST(date_trunc('week', day + 6) AS DATE)"
_WEEK_SUN = "CAST(date_trunc('week', day) + INTERVAL 6 DAY AS DATE)"
_MONTH = "CAST(date_trunc('month', day) AS DATE)"


def _resampled(label: str, step: str, source: str = "base", scale: str | None = None) -> str:
    """SQL of the roll-up of ``base`` to one frequency."""
    prefix = f"'{scale}' AS scale, " if scale else ""
    return f"""
SELECT {prefix}bin, CAST(y AS BIGINT) AS y, {near_sql('rain')} AS rain, {near_sql('temp')} AS temp,
       {near_sql('speed_mean')} AS speed_mean, {near_sql('speed_max')} AS speed_max, {near_sql('gust')} AS gust,
       {near_sql('CASE WHEN sqrt(s*s+c*c) >= 1e-12 THEN s / sqrt(s*s+c*c) END')} AS dir_sin,
       {near_sql('CASE WHEN sqrt(s*s+c*c) >= 1e-12 THEN c / sqrt(s*s+c*c) END')} AS dir_cos
FROM (SELECT CAST(unnest(generate_series(min({label}), max({label}), INTERVAL {step})) AS DATE) AS bin FROM {source})
LEFT JOIN (SELECT {label} AS bin, sum(y) AS y, sum(rain) AS rain, avg(temp) AS temp, avg(speed_mean) AS speed_mean,
                  max(speed_max) AS speed_max, max(gust) AS gust, avg(dir_sin) AS s, avg(dir_cos) AS c
           FROM {source} GROUP BY 1) USING (bin)"""


DIRECTION = ("dir_sin", "dir_cos")


@query("daily_panel_weekly", f"WITH {BASE} {_resampled(_WEEK_MON, '7 DAY')}")
def weekly_mon(spark, sf_dir):
    return rounded(resample(base(spark, sf_dir), [], "day", ROLLUP, "week_mon", DIRECTION))


@query("monthly", f"WITH {BASE} {_resampled(_MONTH, '1 MONTH')}")
def monthly(spark, sf_dir):
    return rounded(resample(base(spark, sf_dir), [], "day", ROLLUP, "month", DIRECTION))


@query("multi_scale", f"""
WITH {BASE}
SELECT 'day' AS scale, day AS bin, CAST(y AS BIGINT) AS y, {near_sql('rain')} AS rain, {near_sql('temp')} AS temp,
       {near_sql('speed_mean')} AS speed_mean, {near_sql('speed_max')} AS speed_max, {near_sql('gust')} AS gust,
       {near_sql('dir_sin')} AS dir_sin, {near_sql('dir_cos')} AS dir_cos FROM base
UNION ALL {_resampled(_WEEK_MON, '7 DAY', scale='week')}
UNION ALL {_resampled(_MONTH, '1 MONTH', scale='month')}""")
def scales(spark, sf_dir):
    return rounded(multi_scale(base(spark, sf_dir), [], "day", ROLLUP, DIRECTION))


@query("weekly_empty_bins", f"""
WITH days AS (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
bins AS (SELECT key, CAST(unnest(generate_series(min({_WEEK_MON}), max({_WEEK_MON}), INTERVAL 7 DAY)) AS DATE) AS bin
         FROM days GROUP BY key),
sums AS (SELECT key, {_WEEK_MON} AS bin, sum(v) AS total, max(v) AS top FROM days GROUP BY ALL)
SELECT key, bin, {near_sql('total')} AS total, {near_sql('top')} AS top FROM bins LEFT JOIN sums USING (key, bin)""")
def empty_bins(spark, sf_dir):
    """A thin series per customer: most weeks are empty and still appear."""
    days = (table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")
            .groupBy(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("day"))
            .agg(F.sum("o_totalprice").alias("v")))
    return rounded(resample(stage(days), ["key"], "day", [Measure("total", "sum", "v"), Measure("top", "max", "v")], "week_mon"))


@query("weekly_sun_legacy", f"""
WITH {SPARSE},
bins AS (SELECT CAST(unnest(generate_series(min({_WEEK_SUN}), max({_WEEK_SUN}), INTERVAL 7 DAY)) AS DATE) AS bin FROM sparse),
agg AS (SELECT {_WEEK_SUN} AS bin, sum(y) AS y, sum(rain) AS rain, avg(temp) AS temp FROM sparse GROUP BY 1)
SELECT bin, {near_sql('coalesce(y, 0)')} AS y, {near_sql('coalesce(rain, 0)')} AS rain, {near_sql('temp')} AS temp
FROM bins LEFT JOIN agg USING (bin) WHERE temp IS NOT NULL""")
def weekly_sun(spark, sf_dir):
    return rounded(resample_legacy(
        sparse(spark, sf_dir), [], "day", [Measure("y", "sum_or_zero", "y"), Measure("rain", "sum_or_zero", "rain")],
        [Measure("temp", "mean", "temp")], "week_sun").withColumn("y", F.col("y").cast("double")))


@query("daily_distinct_count", """
SELECT event_type AS key, CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS users FROM events GROUP BY ALL""")
def distinct_count(spark, sf_dir):
    days = table(spark, sf_dir, "events", "event_type", "ts", "user_id").select(
        F.col("event_type").alias("key"), F.to_date("ts").alias("day"), "user_id")
    return daily_distinct_count(days, ["key"], "user_id", "day", "users")


@query("daily_measures", f"""
WITH {READINGS}, d AS (
  SELECT l_returnflag, l_linestatus, day, avg(temp) AS temp, sum(rain) AS rain, avg(wind_speed) AS speed_mean,
         max(wind_speed) AS speed_max, max(gust) AS gust, count(wind_speed) AS n_records,
         avg(sin(radians(wind_dir))) AS s, avg(cos(radians(wind_dir))) AS c
  FROM readings GROUP BY ALL)
SELECT l_returnflag, l_linestatus, day, {near_sql('temp')} AS temp, {near_sql('rain')} AS rain,
       {near_sql('speed_mean')} AS speed_mean, {near_sql('speed_max')} AS speed_max, {near_sql('gust')} AS gust, n_records,
       {near_sql('CASE WHEN sqrt(s*s+c*c) >= 1e-12 THEN s / sqrt(s*s+c*c) END')} AS dir_sin,
       {near_sql('CASE WHEN sqrt(s*s+c*c) >= 1e-12 THEN c / sqrt(s*s+c*c) END')} AS dir_cos
FROM d""")
def measures(spark, sf_dir):
    keys = ["l_returnflag", "l_linestatus"]
    return rounded(daily_measures(readings(spark, sf_dir, *keys), keys, "day", WEATHER, "wind_dir").drop("dir_angle"))


@query("daily_measures_legacy", f"""
SELECT event_type AS key, CAST(ts AS DATE) AS day,
       {near_sql("coalesce(sum(CASE WHEN event_type <> 'error' THEN value END), 0)")} AS rain,
       {near_sql('avg(value)')} AS temp, {near_sql('max(value)')} AS temp_max, {near_sql('min(value)')} AS temp_min
FROM events GROUP BY ALL""")
def measures_legacy(spark, sf_dir):
    """'error' events carry no rain reading; the legacy rule then reports zero."""
    raw = table(spark, sf_dir, "events", "event_type", "ts", "value").select(
        F.col("event_type").alias("key"), F.to_date("ts").alias("day"), F.col("value").alias("temp"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("rain"))
    return rounded(daily_measures(raw, ["key"], "day", [
        Measure("rain", "sum_or_zero", "rain"), Measure("temp", "mean", "temp"),
        Measure("temp_max", "max", "temp"), Measure("temp_min", "min", "temp")]))


_EVENT_DIR = "avg(sin(radians((value * 37) % 360))) AS s, avg(cos(radians((value * 37) % 360))) AS c"
_ANGLE = "CASE WHEN sqrt(s*s+c*c) >= 1e-12 THEN (degrees(atan2(s, c)) + 360) % 360 END"


def _event_directions(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_type", "ts", "value").select(
        F.col("event_type").alias("key"), F.to_date("ts").alias("day"), (F.col("value") * 37).alias("degrees"))


@query("circular_daily", f"""
SELECT key, day, {near_sql(_ANGLE)} AS mean_angle FROM (
  SELECT event_type AS key, CAST(ts AS DATE) AS day, {_EVENT_DIR} FROM events GROUP BY ALL)""")
def circular_daily(spark, sf_dir):
    return rounded(circular_mean(_event_directions(spark, sf_dir), ["key", "day"], "degrees"))


@query("circular_weekly", f"""
WITH {BASE}, w AS (SELECT {_WEEK_MON} AS bin, avg(dir_sin) AS s, avg(dir_cos) AS c, count(*) AS days FROM base GROUP BY 1),
u AS (SELECT bin, days, CASE WHEN sqrt(s*s+c*c) >= 1e-12 THEN s / sqrt(s*s+c*c) END AS s,
             CASE WHEN sqrt(s*s+c*c) >= 1e-12 THEN c / sqrt(s*s+c*c) END AS c FROM w)
SELECT bin, days, {near_sql('s')} AS dir_sin, {near_sql('c')} AS dir_cos, {near_sql(_ANGLE)} AS dir_angle FROM u""")
def circular_weekly(spark, sf_dir):
    return rounded(circular_reaggregate(base(spark, sf_dir), [], "day", "week_mon"))


@query("monthly_sum_filtered", f"""
SELECT o_orderpriority AS key, make_date(CAST(year(o_orderdate) AS INT), CAST(month(o_orderdate) AS INT), 1) AS month,
       {near_sql('sum(o_totalprice) / 1e6')} AS total
FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL""")
def monthly_sum(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderpriority").alias("key"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("mon"), "o_totalprice")
    return rounded(monthly_balance(rows, ["key"], "year", "mon", "o_totalprice", "total", 1e6))


@query("yearly_stats", f"""
WITH {PANEL} SELECT key, CAST(year(day) AS BIGINT) AS year, {near_sql('avg(y)')} AS mean, {near_sql('stddev_samp(y)')} AS std,
       count(y) AS days, year(day) >= 2000 AS has_test_days FROM panel GROUP BY ALL""")
def yearly(spark, sf_dir):
    return rounded(yearly_stats(panel(spark, sf_dir), ["key"], "day", "y", TEST[0]))


@query("box_stats", f"""
WITH {BASE}, m AS (SELECT CAST(month(day) AS BIGINT) AS month, gust FROM base WHERE gust IS NOT NULL),
q AS (SELECT month, quantile_cont(gust, 0.25) AS q1, quantile_cont(gust, 0.5) AS median, quantile_cont(gust, 0.75) AS q3 FROM m GROUP BY 1)
SELECT month, {near_sql('q1')} AS q1, {near_sql('median')} AS median, {near_sql('q3')} AS q3,
       {near_sql('min(gust) FILTER (gust BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1))')} AS whisker_low,
       {near_sql('max(gust) FILTER (gust BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1))')} AS whisker_high,
       count(*) FILTER (NOT gust BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1)) AS fliers, count(*) AS n
FROM m JOIN q USING (month) GROUP BY month, q1, median, q3""")
def boxes(spark, sf_dir):
    return rounded(box_stats(base(spark, sf_dir).withColumn("month", F.month("day").cast("bigint")), ["month"], "gust"))


@query("box_stats_events", f"""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, {near_sql('value')} AS value, count(*) AS n FROM events JOIN q USING (event_type)
WHERE NOT value BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1) GROUP BY event_type, value""")
def box_fliers(spark, sf_dir):
    """Outlying event values per type, over the raw events."""
    return rounded(fliers(table(spark, sf_dir, "events", "event_type", "value"), ["event_type"], "value"))


@query("band_quartiles", f"""
WITH {BASE}, b AS (SELECT temp, CASE WHEN y < 5 THEN 'low' WHEN y <= 8 THEN 'mid' ELSE 'high' END AS band FROM base WHERE temp IS NOT NULL)
SELECT band, {near_sql('quantile_cont(temp, 0.25)')} AS q1, {near_sql('quantile_cont(temp, 0.5)')} AS median,
       {near_sql('quantile_cont(temp, 0.75)')} AS q3 FROM b GROUP BY band""")
def quartiles(spark, sf_dir):
    return rounded(band_quartiles(base(spark, sf_dir), "temp", "y", (5, 8), ("low", "mid", "high")))


@query("histogram", f"""
WITH v AS (SELECT o_totalprice AS v FROM orders), l AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 60.0 AS w FROM v)
SELECT CAST(least(floor((v - lo) / w), 59) AS BIGINT) AS bin,
       {near_sql('any_value(lo) + CAST(least(floor((v - lo) / w), 59) AS BIGINT) * any_value(w)')} AS left_edge,
       {near_sql('any_value(lo) + (CAST(least(floor((v - lo) / w), 59) AS BIGINT) + 1) * any_value(w)')} AS right_edge,
       count(*) AS n FROM v, l GROUP BY CAST(least(floor((v - lo) / w), 59) AS BIGINT)""")
def hist(spark, sf_dir):
    return rounded(histogram(table(spark, sf_dir, "orders", "o_totalprice"), "o_totalprice", 60))


@query("center", f"""
SELECT o_orderpriority, {near_sql('avg(o_totalprice)', 4)} AS mean, {near_sql('quantile_cont(o_totalprice, 0.5)', 4)} AS median
FROM orders GROUP BY 1""")
def centers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderpriority", "o_totalprice")
    return rounded(center(rows, "o_totalprice", ["o_orderpriority"]), 4)


@query("kde_grid", f"""
WITH {PANEL},
s AS (SELECT key, count(y) AS n, stddev_samp(y) * pow(count(y), -0.2) AS bw, min(y) AS lo, max(y) AS hi FROM panel GROUP BY key),
h AS (SELECT key, y, count(*) AS cnt FROM panel GROUP BY ALL),
g AS (SELECT key, p AS point, (lo - 3*bw) + p * ((hi + 3*bw) - (lo - 3*bw)) / 199.0 AS x, n, bw FROM s, range(200) t(p))
SELECT key, point, {near_sql('x')} AS x,
       {near_sql('sum(cnt * exp(-0.5 * ((x - y) / bw) * ((x - y) / bw)) / (n * bw * sqrt(2 * pi())))', 8)} AS density
FROM g JOIN h USING (key) GROUP BY key, point, x""")
def kde(spark, sf_dir):
    out = density(stage(panel(spark, sf_dir)), "y", 200, ["key"])
    return out.select("key", "point", near("x").alias("x"), near("density", 8).alias("density"))


@query("kde_residuals", f"""
WITH {PREDICTIONS},
r AS (SELECT model, y_real - y_pred AS v FROM preds),
s AS (SELECT model, count(v) AS n, stddev_samp(v) * pow(count(v), -0.2) AS bw, min(v) AS lo, max(v) AS hi FROM r GROUP BY model),
g AS (SELECT model, p AS point, (lo - 3*bw) + p * ((hi + 3*bw) - (lo - 3*bw)) / 199.0 AS x, n, bw FROM s, range(200) t(p))
SELECT model, point, {near_sql('x')} AS x, {near_sql('sum(exp(-0.5 * ((x - v) / bw) * ((x - v) / bw)) / (n * bw * sqrt(2 * pi())))')} AS density
FROM g JOIN r USING (model) GROUP BY model, point, x""")
def kde_residuals(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("model", (F.col("y_real") - F.col("y_pred")).alias("v"))
    return rounded(density(rows, "v", 200, ["model"]))


@query("period_summary", f"""
SELECT o_orderpriority AS key, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day,
       count(*) AS n_rows, {near_sql('avg(o_totalprice)', 4)} AS mean FROM orders GROUP BY 1""")
def summary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderpriority", "o_orderdate", "o_totalprice").select(
        F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day"), "o_totalprice")
    return rounded(period_summary(rows, ["key"], "day", "o_totalprice"), 4)


@query("pivot_metric", f"""
WITH {SUITE}, m AS (SELECT scope, horizon, avg(abs(y_real - y_pred)) AS mae FROM suite GROUP BY ALL)
SELECT scope, """ + ", ".join(near_sql(f"max(mae) FILTER (horizon = {h})") + f' AS "{h}"' for h in (1, 3, 7, 14)) + " FROM m GROUP BY scope")
def pivoted(spark, sf_dir):
    suite = persistence_suite(stage(series(spark, sf_dir)), [], "day", "y", SUITE_SCOPES)
    return rounded(pivot_metric(forecast_metrics(suite, ["scope", "horizon"]), ["scope"], "horizon", [1, 3, 7, 14], "mae"))
