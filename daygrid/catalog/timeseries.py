"""Ordered-window operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from daygrid.catalog.registry import (
    BASE, PANEL, SERIES, SPARSE, base, near_sql, panel, query, rounded, series, sparse, stage, table)
from daygrid.operators.windows import (
    calendar_features, causal_fill, decompose_additive, ema, fill_with_train_median, interpolate_linear,
    interpolate_time, lags, lead_target, renormalise_direction, rolling_mean, rolling_std, sequence_windows,
    undefined_directions)
from daygrid.plans.features import EMA_SPANS, LAG_DAYS, SMOOTHED, build_features, feature_columns

_LAGS = ", ".join(f"lag(y, {k}) OVER w AS y_lag_{k}" for k in LAG_DAYS)


@query("lags", f"WITH {PANEL} SELECT key, day, y, {_LAGS} FROM panel WINDOW w AS (PARTITION BY key ORDER BY day)")
def lag_table(spark, sf_dir):
    return lags(panel(spark, sf_dir), ["key"], "day", ["y"], LAG_DAYS)


@query("rolling_mean", f"""
WITH {PANEL} SELECT key, day, """ + ", ".join(
    near_sql(f"avg(y) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)") + f" AS y_mean_{n}d"
    for n in (7, 14, 30)) + " FROM panel")
def rolling_means(spark, sf_dir):
    return rounded(rolling_mean(panel(spark, sf_dir), ["key"], "day", ["y"], (7, 14, 30)).drop("y"))


@query("rolling_std", f"""
WITH {PANEL} SELECT key, day, """ + near_sql(
    "CASE WHEN count(y) OVER w = 7 THEN stddev_samp(y) OVER w END") + """ AS y_std_7d
FROM panel WINDOW w AS (PARTITION BY key ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def rolling_deviation(spark, sf_dir):
    return rounded(rolling_std(panel(spark, sf_dir), ["key"], "day", ["y"]).drop("y"))


def _ema_sql(source: str, cols, key: bool) -> str:
    """Recursive CTE that follows the definition row by row."""
    names = [(c, s, f"{c}_ema_{s}") for c in cols for s in EMA_SPANS]
    first = ", ".join(f"CAST({c} AS DOUBLE) AS {n}" for c, _, n in names)
    step = ", ".join(f"(2.0 / {s + 1}) * n.{c} + (1 - 2.0 / {s + 1}) * e.{n}" for c, s, n in names)
    part, k, nk, join = ("PARTITION BY key ", "key, ", "n.key, ", "n.key = e.key AND ") if key else ("", "", "", "")
    return f"""numbered AS (SELECT *, row_number() OVER ({part}ORDER BY day) AS i FROM {source}),
emas AS (SELECT {k}i, day, {first} FROM numbered WHERE i = 1
         UNION ALL SELECT {nk}n.i, n.day, {step} FROM emas e JOIN numbered n ON {join}n.i = e.i + 1)"""


@query("ema", f"WITH RECURSIVE {PANEL}, {_ema_sql('panel', ['y'], True)} SELECT key, day, "
       + ", ".join(near_sql(f"y_ema_{s}") + f" AS y_ema_{s}" for s in EMA_SPANS) + " FROM emas")
def emas(spark, sf_dir):
    return rounded(ema(panel(spark, sf_dir), ["key"], "day", ["y"], EMA_SPANS).drop("y"))


def _around(c: str) -> str:
    """Position and value of the nearest known rows."""
    return f"""last_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER b AS p0, last_value({c} IGNORE NULLS) OVER b AS v0,
       first_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER f AS p1, first_value({c} IGNORE NULLS) OVER f AS v1"""


_FRAMES = """WINDOW b AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       f AS (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
_BETWEEN = "WHEN p0 IS NOT NULL AND p1 IS NOT NULL THEN v0 + (v1 - v0) / (p1 - p0) * (i - p0)"


def _linear_sql(c: str) -> str:
    return f"""SELECT day, {near_sql(f'CASE WHEN {c} IS NOT NULL THEN {c} {_BETWEEN} ELSE coalesce(v0, v1) END')} AS {c}
FROM (SELECT day, {c}, i, {_around(c)} FROM n {_FRAMES})"""


@query("interpolate_linear", f"""
WITH {SPARSE}, n AS (SELECT *, CAST(day - DATE '1970-01-01' AS BIGINT) AS i FROM sparse),
a AS ({_linear_sql('rain')}), b AS ({_linear_sql('temp')})
SELECT day, rain, temp FROM a JOIN b USING (day)""")
def linear(spark, sf_dir):
    return rounded(interpolate_linear(sparse(spark, sf_dir), [], "day", ["rain", "temp"]).select("day", "rain", "temp"))


@query("interpolate_time", """
WITH vals AS (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS day,
                     max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS v FROM orders GROUP BY ALL),
n AS (SELECT *, CAST(day - DATE '1970-01-01' AS BIGINT) AS i FROM vals),
a AS (SELECT key, day, v, i,
  last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS p0, last_value(v IGNORE NULLS) OVER b AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f AS p1, first_value(v IGNORE NULLS) OVER f AS v1
  FROM n WINDOW b AS (PARTITION BY key ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                f AS (PARTITION BY key ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT key, day, """ + near_sql(f"CASE WHEN v IS NOT NULL THEN v {_BETWEEN} ELSE v0 END") + " AS v FROM a")
def by_time(spark, sf_dir):
    """Irregular dates per customer; only filled orders have a value."""
    rows = (table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
            .groupBy(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("day"))
            .agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("v")))
    return rounded(interpolate_time(stage(rows), ["key"], "day", ["v"]))


@query("causal_fill", f"""
WITH {SPARSE} SELECT day, {near_sql('last_value(rain IGNORE NULLS) OVER w')} AS rain,
  {near_sql('last_value(temp IGNORE NULLS) OVER w')} AS temp
FROM sparse WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def from_the_past(spark, sf_dir):
    return rounded(causal_fill(sparse(spark, sf_dir), [], "day", ["rain", "temp"]).select("day", "rain", "temp"))


@query("renormalise_direction", f"""
WITH {BASE}, mixed AS (SELECT day, (dir_sin + lag(dir_sin) OVER w) / 2 AS s, (dir_cos + lag(dir_cos) OVER w) / 2 AS c
                       FROM base WINDOW w AS (ORDER BY day))
SELECT day, {near_sql('s / sqrt(s*s + c*c)')} AS dir_sin, {near_sql('c / sqrt(s*s + c*c)')} AS dir_cos
FROM mixed WHERE s IS NOT NULL AND c IS NOT NULL AND sqrt(s*s + c*c) >= 1e-12""")
def renormalised(spark, sf_dir):
    """Halfway vectors between neighbouring days are shorter than one."""
    both = lags(base(spark, sf_dir), [], "day", ["dir_sin", "dir_cos"], [1])
    mixed = both.select("day", ((F.col("dir_sin") + F.col("dir_sin_lag_1")) / 2).alias("dir_sin"),
                        ((F.col("dir_cos") + F.col("dir_cos_lag_1")) / 2).alias("dir_cos")).dropna()
    bad = undefined_directions(mixed).select("day")
    return rounded(renormalise_direction(mixed.join(bad, "day", "left_anti")))


@query("fill_with_train_median", f"""
WITH {SPARSE}, m AS (SELECT quantile_cont(rain, 0.5) AS rain, quantile_cont(temp, 0.5) AS temp FROM sparse WHERE day < DATE '2000-01-01')
SELECT day, y, {near_sql('coalesce(s.rain, m.rain)')} AS rain, {near_sql('coalesce(s.temp, m.temp)')} AS temp FROM sparse s, m""")
def train_median(spark, sf_dir):
    return rounded(fill_with_train_median(sparse(spark, sf_dir), [], "day", ["rain", "temp"], "2000-01-01"))


def _decompose_sql(source: str, value: str, period: int) -> str:
    half = period // 2
    edge = "" if period % 2 else f" - 0.5 * (lag(v, {half}) OVER o + lead(v, {half}) OVER o)"
    return f"""
n AS (SELECT day, CAST({value} AS DOUBLE) AS v, row_number() OVER (ORDER BY day) - 1 AS i FROM {source}),
t AS (SELECT *, CASE WHEN count(v) OVER w = {2 * half + 1} THEN (sum(v) OVER w{edge}) / {period} END AS trend FROM n
      WINDOW w AS (ORDER BY day ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING), o AS (ORDER BY day)),
ph AS (SELECT i % {period} AS ph, avg(v - trend) AS m FROM t GROUP BY 1),
s AS (SELECT ph, m - (SELECT avg(m) FROM ph) AS seasonal FROM ph)
SELECT day, {near_sql('v')} AS observed, {near_sql('trend')} AS trend, {near_sql('seasonal')} AS seasonal,
       {near_sql('v - trend - seasonal')} AS residual FROM t JOIN s ON s.ph = t.i % {period}"""


@query("decompose_additive", f"WITH {SERIES}, {_decompose_sql('series', 'y', 365)}")
def decomposed(spark, sf_dir):
    return rounded(decompose_additive(stage(series(spark, sf_dir)), [], "day", "y", 365))


@query("decompose_even_period", f"WITH {BASE}, {_decompose_sql('base', 'rain', 14)}")
def decomposed_even(spark, sf_dir):
    return rounded(decompose_additive(base(spark, sf_dir), [], "day", "rain", 14))


_CALENDAR = f"""CAST(month(day) AS BIGINT) AS month, CAST(isodow(day) - 1 AS BIGINT) AS weekday,
       CAST(dayofyear(day) AS BIGINT) AS day_of_year, {near_sql(f'sin({2 * math.pi!r} * month(day) / 12)')} AS month_sin,
       {near_sql(f'cos({2 * math.pi!r} * month(day) / 12)')} AS month_cos"""


@query("calendar_features", f"WITH {SERIES} SELECT day, y, {_CALENDAR} FROM series")
def calendar(spark, sf_dir):
    return rounded(calendar_features(series(spark, sf_dir), "day"))


@query("lead_target_with_gaps", f"""
WITH {PANEL}, g AS (SELECT * FROM panel WHERE dayofweek(day) <> 0)
SELECT g.key, g.day, g.y, t.y AS label, t.day AS target FROM g JOIN g t ON t.key = g.key AND t.day = g.day + 3""")
def lead_over_gaps(spark, sf_dir):
    """Days without a Sunday: a label that would fall on one is missing, never that of another day."""
    return lead_target(panel(spark, sf_dir).where(F.dayofweek("day") != 1), ["key"], "day", "y", 3)


@query("lead_target", f"""
WITH {PANEL}, l AS (SELECT key, day, y, lead(y, 14) OVER (PARTITION BY key ORDER BY day) AS label FROM panel)
SELECT key, day, y, label, day + 14 AS target FROM l WHERE label IS NOT NULL""")
def leads(spark, sf_dir):
    return lead_target(panel(spark, sf_dir), ["key"], "day", "y", 14)


@query("sequence_windows", f"""
WITH {PANEL}, w AS (SELECT key, day, list(y) OVER f AS ys, sum(y) OVER f AS total, lead(y, 7) OVER (PARTITION BY key ORDER BY day) AS label
                    FROM panel WINDOW f AS (PARTITION BY key ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT key, day AS origin, day + 7 AS target, array_to_string(ys, ',') AS steps,
       CAST(total AS DOUBLE) AS total, CAST(label AS DOUBLE) AS label
FROM w WHERE len(ys) = 14 AND label IS NOT NULL""")
def sequences(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumn("twice", F.col("y") * 2)
    wide = sequence_windows(rows, ["key"], "day", ["y", "twice"], "y", 14, 7)
    text = F.array_join(F.transform("window", lambda step: step[0].cast("bigint").cast("string")), ",")
    total = F.aggregate("window", F.lit(0.0), lambda a, step: a + step[1] - step[0])
    return wide.select("key", "origin", "target", text.alias("steps"), total.alias("total"), "label")


# --- the feature table ---------------------------------------------------------------------


def _feature_ctes() -> str:
    """Base, filled and shifted days, and the averages, as common table expressions."""
    measures = ("temp", "rain", "speed_mean", "speed_max", "gust")
    fill = lambda c: f"""CASE WHEN {c} IS NOT NULL THEN {c}
      WHEN p0_{c} IS NOT NULL AND p1_{c} IS NOT NULL THEN v0_{c} + (v1_{c} - v0_{c}) / (p1_{c} - p0_{c}) * (i - p0_{c})
      ELSE coalesce(v0_{c}, v1_{c}) END AS {c}"""
    names = (*measures, "dir_sin", "dir_cos")
    around = ", ".join(f"""last_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER b AS p0_{c},
      last_value({c} IGNORE NULLS) OVER b AS v0_{c},
      first_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER f AS p1_{c},
      first_value({c} IGNORE NULLS) OVER f AS v1_{c}""" for c in names)
    smoothed = list(SMOOTHED)
    lag_cols = ", ".join(f"lag({c}, {k}) OVER o AS {c}_lag_{k}" for c in ("y", *smoothed) for k in LAG_DAYS)
    std_cols = ", ".join(f"CASE WHEN count({c}) OVER s7 = 7 THEN stddev_samp({c}) OVER s7 END AS {c}_std_7d" for c in smoothed)
    return f"""{BASE},
n AS (SELECT *, CAST(day - DATE '1970-01-01' AS BIGINT) AS i FROM base),
near AS (SELECT *, {around} FROM n {_FRAMES}),
filled0 AS (SELECT day, y, {", ".join(fill(c) for c in names)} FROM near),
filled AS (SELECT day, y, {", ".join(measures)}, dir_sin / sqrt(dir_sin*dir_sin + dir_cos*dir_cos) AS dir_sin,
                  dir_cos / sqrt(dir_sin*dir_sin + dir_cos*dir_cos) AS dir_cos, {_CALENDAR} FROM filled0),
shifted AS (SELECT *, {lag_cols}, {std_cols} FROM filled
            WINDOW o AS (ORDER BY day), s7 AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
{_ema_sql('filled', smoothed, False)}"""


FEATURE_CTES = _feature_ctes()
COMPLETE = "y_lag_7 IS NOT NULL AND rain_std_7d IS NOT NULL AND temp_lag_7 IS NOT NULL"


def _feature_sql() -> str:
    exact = {"y", "month", "weekday", "day_of_year", "month_sin", "month_cos", *[f"y_lag_{k}" for k in LAG_DAYS]}
    picked = ", ".join(c if c in exact else f"{near_sql(c)} AS {c}" for c in feature_columns())
    return f"WITH RECURSIVE {FEATURE_CTES} SELECT day, {picked} FROM shifted JOIN emas USING (day) WHERE {COMPLETE}"


@query("feature_table", _feature_sql())
def feature_table(spark, sf_dir):
    table_ = build_features(base(spark, sf_dir), [])
    return rounded(table_.select("day", *feature_columns()))

