"""Query registry and the inputs the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from daygrid.functions.columns import floor_to_day
from daygrid.operators.forecast import moving_average_forecast, persistence, recut_predictions
from daygrid.operators.quality import dedup_events
from daygrid.plans.base import daily_base, daily_target, daily_weather
from daygrid.sources.readers import scan_parquet
from daygrid.stage import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Files are not tables: SQL over their bytes names the folder it is checked in.
SQL_DIR = "/root/testdata/sf0.01"
# The test year; the study period is that of the orders.
TEST = ("2000-08-01", "2001-07-31")
COMMON_TEST = ("2000-08-14", "2001-07-31")
MODELS = ("persistence", "mean_7d", "mean_30d")


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build
    return register


def near(value: str | Column, digits: int = 6) -> Column:
    """Round for comparison; the tiny shift keeps both engines off exact ties, the zero off -0.0."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c + F.lit(1e-9), digits) + F.lit(0.0)


def near_sql(expression: str, digits: int = 6) -> str:
    return f"(round(CAST({expression} AS DOUBLE) + 1e-9, {digits}) + CAST(0 AS DOUBLE))"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column and widen every integer column."""
    return df.select(*[
        F.expr(f"round(`{c}` + 1e-9D, {digits}) + 0D AS `{c}`") if t in ("double", "float")
        else F.expr(f"bigint(`{c}`) AS `{c}`") if t in ("int", "smallint", "tinyint") else c
        for c, t in df.dtypes])


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str, where: str | None = None) -> DataFrame:
    return scan_parquet(spark, f"{sf_dir}/{name}.parquet", cols or None, where)


# --- event series ----------------------------------------------------------------------


def orders_as_events(spark, sf_dir, *keys) -> DataFrame:
    """One row per order: the earliest start, as event records may repeat."""
    raw = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", *keys)
    return dedup_events(raw, ["o_orderkey"], "o_orderdate", keys).withColumnRenamed("o_orderdate", "start")


def series(spark, sf_dir) -> DataFrame:
    """Daily order count, gap-free (day, y)."""
    return daily_target(orders_as_events(spark, sf_dir), [])


def panel(spark, sf_dir) -> DataFrame:
    """Daily order count per priority (key, day, y)."""
    events = orders_as_events(spark, sf_dir, "o_orderpriority").withColumnRenamed("o_orderpriority", "key")
    return daily_target(events, ["key"])


SERIES = """
ev AS (SELECT o_orderkey AS id, min(o_orderdate) AS ts FROM orders GROUP BY 1),
counts AS (SELECT CAST(ts AS DATE) AS day, count(*) AS c FROM ev GROUP BY 1),
cal AS (SELECT CAST(d AS DATE) AS day
        FROM (SELECT unnest(generate_series((SELECT min(day) FROM counts), (SELECT max(day) FROM counts), INTERVAL 1 DAY)) AS d)),
series AS (SELECT cal.day, coalesce(c, 0) AS y FROM cal LEFT JOIN counts USING (day))"""

PANEL = """
pev AS (SELECT id, ts, key FROM (
  SELECT o_orderkey AS id, o_orderdate AS ts, o_orderpriority AS key,
         row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate, o_orderpriority) AS rn
  FROM orders) WHERE rn = 1),
pcounts AS (SELECT key, CAST(ts AS DATE) AS day, count(*) AS c FROM pev GROUP BY 1, 2),
pcal AS (SELECT key, CAST(d AS DATE) AS day FROM (SELECT DISTINCT key FROM pcounts),
         (SELECT unnest(generate_series((SELECT min(day) FROM pcounts), (SELECT max(day) FROM pcounts), INTERVAL 1 DAY)) AS d)),
panel AS (SELECT pcal.key, pcal.day, coalesce(c, 0) AS y FROM pcal LEFT JOIN pcounts USING (key, day))"""


# --- readings ----------------------------------------------------------------------------


def readings(spark, sf_dir, *keys) -> DataFrame:
    """Line items in the role of sensor readings."""
    raw = table(spark, sf_dir, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", *keys)
    return raw.select(
        *keys, floor_to_day("l_shipdate").alias("day"), F.col("l_quantity").alias("rain"),
        (F.col("l_discount") * 100).alias("temp"), F.pmod("l_extendedprice", F.lit(360.0)).alias("wind_dir"),
        (F.col("l_extendedprice") / 1000).alias("gust"), (F.col("l_tax") * 100).alias("wind_speed"))


def base(spark, sf_dir) -> DataFrame:
    """Daily count joined with the daily measures, stored once because its readers branch."""
    return stage(daily_base(series(spark, sf_dir), daily_weather(readings(spark, sf_dir), []), []))


RARE = "l_returnflag = 'A' AND l_linestatus = 'F' AND l_tax = 0.08"


def rare_readings(spark, sf_dir) -> DataFrame:
    """All line items by day; readings outside one narrow class count as missing, so many days have none."""
    rows = table(spark, sf_dir, "lineitem", "l_shipdate", "l_discount", "l_quantity", "l_returnflag", "l_linestatus", "l_tax")
    valid = lambda c: F.when(F.expr(RARE), c)
    return rows.groupBy(floor_to_day("l_shipdate").alias("day")).agg(
        F.avg(valid(F.col("l_discount") * 100)).alias("temp"), F.sum(valid(F.col("l_quantity"))).alias("rain"))


def sparse(spark, sf_dir) -> DataFrame:
    """The base with readings that are missing on many days."""
    return stage(series(spark, sf_dir).join(rare_readings(spark, sf_dir), "day", "left"))


READINGS = """
readings AS (SELECT CAST(l_shipdate AS DATE) AS day, l_quantity AS rain, l_discount * 100 AS temp,
                    l_extendedprice % 360 AS wind_dir, l_extendedprice / 1000 AS gust, l_tax * 100 AS wind_speed,
                    l_returnflag, l_linestatus
             FROM lineitem)"""

WEATHER = READINGS + """,
wx0 AS (SELECT day, avg(temp) AS temp, sum(rain) AS rain, avg(wind_speed) AS speed_mean, max(wind_speed) AS speed_max,
               max(gust) AS gust, count(wind_speed) AS n_records,
               avg(sin(radians(wind_dir))) AS s, avg(cos(radians(wind_dir))) AS c
        FROM readings GROUP BY day),
wx AS (SELECT * EXCLUDE (s, c),
              CASE WHEN sqrt(s * s + c * c) >= 1e-12 THEN s / sqrt(s * s + c * c) END AS dir_sin,
              CASE WHEN sqrt(s * s + c * c) >= 1e-12 THEN c / sqrt(s * s + c * c) END AS dir_cos
       FROM wx0)"""

BASE = SERIES + "," + WEATHER + """,
base AS (SELECT series.day, y, temp, rain, speed_mean, speed_max, gust, n_records, dir_sin, dir_cos
         FROM series LEFT JOIN wx USING (day))"""

SPARSE = SERIES + f""",
rare AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(CASE WHEN {RARE} THEN l_discount * 100 END) AS temp,
                sum(CASE WHEN {RARE} THEN l_quantity END) AS rain
         FROM lineitem GROUP BY 1),
sparse AS (SELECT series.day, y, temp, rain FROM series LEFT JOIN rare USING (day))"""


# --- predictions ---------------------------------------------------------------------------


def predictions(spark, sf_dir) -> DataFrame:
    """Three baselines one day ahead over the test year, as a stored long table."""
    days = stage(series(spark, sf_dir))
    every = (persistence(days, [], "day", "y")
             .unionByName(moving_average_forecast(days, [], "day", "y", 7))
             .unionByName(moving_average_forecast(days, [], "day", "y", 30)))
    return stage(recut_predictions(every, *TEST))


def _model_sql(name: str, expression: str) -> str:
    return (f"SELECT '{name}' AS model, 1 AS horizon, day - 1 AS origin, day AS target, "
            f"CAST(y AS DOUBLE) AS y_real, CAST({expression} AS DOUBLE) AS y_pred FROM series")


PREDICTIONS = SERIES + ",\nevery AS (" + "\nUNION ALL ".join([
    _model_sql("persistence", "lag(y) OVER (ORDER BY day)"),
    _model_sql("mean_7d", "avg(y) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"),
    _model_sql("mean_30d", "avg(y) OVER (ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"),
]) + f"""),
preds AS (SELECT * FROM every WHERE target BETWEEN DATE '{TEST[0]}' AND DATE '{TEST[1]}')"""

SUITE_SCOPES = [("main_365", 1, *TEST)] + [("common_352", h, *COMMON_TEST) for h in (1, 3, 7, 14)]

SUITE = SERIES + """,
scopes AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{s}', {h}, DATE '{a}', DATE '{b}')" for s, h, a, b in SUITE_SCOPES) + """) AS v(scope, horizon, a, b)),
suite AS (SELECT scope, 'persistence' AS model, horizon, t.day - horizon AS origin, t.day AS target,
                 CAST(t.y AS DOUBLE) AS y_real, CAST(o.y AS DOUBLE) AS y_pred
          FROM scopes JOIN series t ON t.day BETWEEN a AND b JOIN series o ON o.day = t.day - horizon)"""

METRICS = f"""count(*) AS n, {near_sql('avg(abs(y_real - y_pred))')} AS mae,
       {near_sql('sqrt(avg((y_real - y_pred) * (y_real - y_pred)))')} AS rmse,
       {near_sql('CASE WHEN count(*) > 1 AND var_pop(y_real) > 0 THEN 1 - sum((y_real - y_pred) * (y_real - y_pred)) / (var_pop(y_real) * count(*)) END')} AS r2,
       {near_sql('100 * avg(CASE WHEN y_real <> 0 THEN abs((y_real - y_pred) / y_real) END)')} AS mape"""


__all__ = ["BASE", "COMMON_TEST", "METRICS", "MODELS", "PANEL", "PREDICTIONS", "QUERIES", "READINGS",
           "RARE", "SERIES", "SPARSE", "SQL", "SQL_DIR", "SUITE", "SUITE_SCOPES", "TEST", "WEATHER", "base",
           "near", "near_sql", "orders_as_events", "panel", "predictions",
           "query", "rare_readings", "readings", "rounded", "series", "sparse", "stage", "table"]
