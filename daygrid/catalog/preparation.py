"""Sources, quality rules, projections and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from daygrid.catalog.registry import (
    BASE, COMMON_TEST, MODELS, PANEL, PREDICTIONS, RARE, READINGS, SERIES, SPARSE, TEST,
    base, near_sql, panel, predictions, query, rare_readings, readings, rounded, series, sparse, stage, table, SQL_DIR)
from daygrid.functions.columns import VOLUME_BANDS, band, band_order, clip_non_negative
from daygrid.operators.calendar import complete_calendar, expected_row_count, reindex_calendar
from daygrid.operators.forecast import union_model_results
from daygrid.operators.joins import (
    actuals_with_predictions, at_offset, inner_by_day, inner_by_month, left_align, missing_offsets,
    models_side_by_side)
from daygrid.operators.learning import direct_task
from daygrid.operators.quality import (
    Guard, apply_domain_rules, common_dates, conflicting_duplicates, date_gaps, dedup_events,
    drop_conflicts, duplicate_keys, experiment_bounds, integer_target, invalid_keys, no_leakage, null_counts,
    numeric_target, prediction_coverage, read_sentinel, same_actuals_across_models, same_dates_across_models,
    require, require_one_to_one, target_covers_predictions)
from daygrid.operators.rollup import daily_count, target_profile
from daygrid.operators.shape import (
    aligned_series, drop_incomplete, equal_to, filter_period, filter_year, last_year_window, monthly_balance,
    rename_and_label, scatter_table, threshold_contingency)
from daygrid.plans.base import clean_hourly, daily_base, daily_weather
from daygrid.sources.files import fingerprint_files, source_manifest
from daygrid.sources.readers import load_daily_base, scan_drop_malformed, scan_events_csv, scan_hourly_csv, unique_events
from daygrid.sources.sinks import check_stored, write_outputs
from daygrid.stage import checkpoint_root

LINE = ["l_orderkey", "l_linenumber"]
VALUES = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
          "l_linestatus", "l_shipdate"]

# --- sources ------------------------------------------------------------------------------


@query("scan_events", """
SELECT count(*) AS raw_rows, count(DISTINCT o_orderkey) AS events,
       CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders""")
def scan_events(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count_distinct("o_orderkey").alias("events"),
        F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"))


@query("read_with_sentinels", f"""
SELECT l_returnflag, count(*) AS n_rows, count(nullif(l_quantity, 50)) AS known,
       {near_sql('avg(nullif(l_quantity, 50))')} AS mean_quantity
FROM lineitem GROUP BY 1""")
def sentinels(spark, sf_dir):
    """Quantity 50 in the role of the code for "missing"."""
    raw = read_sentinel(table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity"), ["l_quantity"], 50.0)
    return rounded(raw.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("l_quantity").alias("known"),
        F.avg("l_quantity").alias("mean_quantity")))


@query("source_profile", f"""
WITH {SERIES}
SELECT CAST(sum(y) AS BIGINT) AS events, count(*) AS days, count(*) FILTER (y = 0) AS zero_days,
       {near_sql('avg(y)')} AS daily_mean, max(y) AS daily_max, {near_sql('quantile_cont(y, 0.5)')} AS daily_median
FROM series""")
def source_profile(spark, sf_dir):
    return rounded(target_profile(stage(series(spark, sf_dir)), "y"))


@query("source_profile_by_key", f"""
WITH {PANEL}
SELECT key, CAST(sum(y) AS BIGINT) AS events, count(*) AS days, count(*) FILTER (y = 0) AS zero_days,
       {near_sql('avg(y)')} AS daily_mean, max(y) AS daily_max, {near_sql('quantile_cont(y, 0.5)')} AS daily_median
FROM panel GROUP BY key""")
def source_profile_by_key(spark, sf_dir):
    return rounded(target_profile(stage(panel(spark, sf_dir)), "y", ["key"]))


@query("source_manifest", f"""
WITH {SERIES}, f AS (SELECT size AS length FROM read_blob('{SQL_DIR}/orders.parquet'))
SELECT 'run' AS run_id, 'unique orders per day' AS target, (SELECT count(*) FROM orders) AS raw_rows, min(day) AS "start", max(day) AS "end",
  CAST(sum(y) AS BIGINT) AS events, count(*) AS days, count_if(y = 0)::BIGINT AS zero_days, {near_sql('avg(y)')} AS daily_mean,
  max(y) AS daily_max, {near_sql('quantile_cont(y, 0.5)')} AS daily_median, (SELECT count(*) FROM f) AS files,
  (SELECT CAST(sum(length) AS BIGINT) FROM f) AS bytes FROM series""")
def manifest(spark, sf_dir):
    raw = table(spark, sf_dir, "orders", "o_orderkey").agg(F.count(F.lit(1)))
    files = fingerprint_files(spark, sf_dir, "orders.parquet")
    summary, _ = source_manifest(stage(series(spark, sf_dir)), "y", "day", raw, files, "unique orders per day", "run")
    return rounded(summary)


@query("fingerprint_files", " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS file, size AS length, sha256(content) AS sha256 FROM read_blob('{SQL_DIR}/{t}.parquet')"
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")))
def fingerprints(spark, sf_dir):
    return fingerprint_files(spark, sf_dir, "{region,nation,customer,supplier,part,orders,lineitem,events}.parquet")


@query("union_model_results", f"""
WITH {PREDICTIONS}
SELECT model, CAST(horizon AS BIGINT) AS horizon, origin, target, {near_sql('y_real')} AS y_real,
       {near_sql('y_pred')} AS y_pred FROM preds""")
def union_results(spark, sf_dir):
    long = predictions(spark, sf_dir)
    tables = {m: long.where(F.col("model") == m).select(
        F.col("target").alias("day"), F.col("y_real").alias("real"), F.col("y_pred").alias("pred")) for m in MODELS}
    return rounded(union_model_results(tables))


# --- quality --------------------------------------------------------------------------------


@query("duplicate_keys", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS copies
FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicates(spark, sf_dir):
    return rounded(duplicate_keys(table(spark, sf_dir, "lineitem", *LINE), LINE))


@query("invalid_keys", """
SELECT event_type, count(*) AS bad FROM events
WHERE nullif(event_type, 'error') IS NULL
   OR TRY_CAST('2024-01-' || json_extract_string(props, '$.k') AS TIMESTAMP) IS NULL
GROUP BY 1""")
def bad_keys(spark, sf_dir):
    """'error' events count as having no id; the props number is read as a day of January."""
    raw = table(spark, sf_dir, "events", "event_type", "props").select(
        "event_type", F.nullif("event_type", F.lit("error")).alias("id"),
        F.concat(F.lit("2024-01-"), F.get_json_object("props", "$.k")).alias("start"))
    return invalid_keys(raw, ["id"], ["start"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("bad"))


_DIFFERS = " OR ".join(f"count(DISTINCT {v}) + max(CASE WHEN {v} IS NULL THEN 1 ELSE 0 END) > 1" for v in VALUES)


@query("conflicting_duplicates", f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS copies
FROM lineitem GROUP BY ALL HAVING count(*) > 1 AND ({_DIFFERS})""")
def conflicts(spark, sf_dir):
    return rounded(conflicting_duplicates(table(spark, sf_dir, "lineitem"), LINE, VALUES))


@query("identical_duplicates", """
SELECT user_id, event_type, count(*) AS readings FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL""")
def identical(spark, sf_dir):
    """Copies of the (user, type) part of an event agree by construction and collapse to one."""
    raw = table(spark, sf_dir, "events", "user_id", "event_type").withColumn("kind", F.col("event_type"))
    single = drop_conflicts(raw, ["user_id", "event_type"], ["kind"])
    return single.groupBy("user_id", "event_type").agg(F.count("kind").alias("readings"))


@query("drop_conflicts", f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {near_sql('min(l_quantity)')} AS l_quantity,
       {near_sql('min(l_discount)')} AS l_discount
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING NOT ({_DIFFERS})""")
def without_conflicts(spark, sf_dir):
    kept = drop_conflicts(table(spark, sf_dir, "lineitem"), LINE, VALUES)
    return rounded(kept.select(*LINE, "l_quantity", "l_discount"))


@query("dedup_events", f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_shipdate AS DATE) AS day,
       {near_sql('l_quantity')} AS l_quantity, {near_sql('l_extendedprice')} AS l_extendedprice
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                   ORDER BY l_shipdate, l_quantity, l_extendedprice) AS rn FROM lineitem)
WHERE rn = 1""")
def dedup(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem", *LINE, "l_shipdate", "l_quantity", "l_extendedprice")
    first = dedup_events(raw, LINE, "l_shipdate", ["l_quantity", "l_extendedprice"])
    return rounded(first.select(*LINE, F.to_date("l_shipdate").alias("day"), "l_quantity", "l_extendedprice"))


@query("date_gaps", """
WITH days AS (SELECT DISTINCT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS day FROM orders),
     steps AS (SELECT key, day, lag(day) OVER (PARTITION BY key ORDER BY day) AS previous FROM days)
SELECT key, previous, day, CAST(day - previous - 1 AS BIGINT) AS missing_days FROM steps WHERE day - previous > 1""")
def gaps(spark, sf_dir):
    days = table(spark, sf_dir, "orders", "o_orderpriority", "o_orderdate").select(
        F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day")).distinct()
    return date_gaps(stage(days), ["key"], "day")


@query("null_counts", f"""
WITH {SPARSE}
SELECT 'y' AS "column", count(*) FILTER (y IS NULL) AS nulls FROM sparse
UNION ALL SELECT 'temp', count(*) FILTER (temp IS NULL) FROM sparse
UNION ALL SELECT 'rain', count(*) FILTER (rain IS NULL) FROM sparse""")
def nulls(spark, sf_dir):
    return null_counts(sparse(spark, sf_dir), ["y", "temp", "rain"])


@query("domain_clean", f"""
WITH {READINGS}, coded AS (
  SELECT day, CASE WHEN l_returnflag = 'R' THEN -9999 ELSE rain END AS rain, temp - 5 AS temp,
         wind_dir + 30 AS wind_dir, wind_speed - 2 AS wind_speed FROM readings)
SELECT day, count(CASE WHEN rain > -999 AND rain >= 0 THEN 1 END) AS rain_n,
       {near_sql('sum(CASE WHEN rain > -999 AND rain >= 0 THEN rain END)')} AS rain,
       {near_sql('avg(CASE WHEN temp > -999 THEN temp END)')} AS temp,
       {near_sql('avg(CASE WHEN wind_dir BETWEEN 0 AND 360 THEN wind_dir END)')} AS wind_dir,
       {near_sql('max(CASE WHEN wind_speed >= 0 THEN wind_speed END)')} AS wind_speed
FROM coded WHERE day BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY day""")
def domain_clean(spark, sf_dir):
    """Shifted readings with a sentinel code, so that every rule has something to reject."""
    raw = readings(spark, sf_dir, "l_returnflag").withColumns({
        "rain": F.when(F.col("l_returnflag") == "R", F.lit(-9999.0)).otherwise(F.col("rain")),
        "temp": F.col("temp") - 5, "wind_dir": F.col("wind_dir") + 30, "wind_speed": F.col("wind_speed") - 2})
    clean = apply_domain_rules(filter_period(raw, "day", "1996-01-01", "1999-12-31"),
                               ["rain", "temp", "wind_dir", "wind_speed"], non_negative=["rain", "wind_speed"],
                               ranges={"wind_dir": (0.0, 360.0)})
    return rounded(clean.groupBy("day").agg(
        F.count("rain").alias("rain_n"), F.sum("rain").alias("rain"), F.avg("temp").alias("temp"),
        F.avg("wind_dir").alias("wind_dir"), F.max("wind_speed").alias("wind_speed")))


@query("filter_period", f"""
SELECT o_orderpriority, count(*) AS n FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1999-07-01' GROUP BY 1""")
def period(spark, sf_dir):
    raw = table(spark, sf_dir, "orders", "o_orderdate", "o_orderpriority")
    return filter_period(raw, "o_orderdate", "1997-03-01", "1999-06-30").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"))


@query("integer_target", """
SELECT p_partkey, p_retailprice AS price FROM part
WHERE NOT abs(p_retailprice - round_even(p_retailprice, 0)) <= 1e-8 + 1e-5 * abs(round_even(p_retailprice, 0))""")
def not_integer(spark, sf_dir):
    parts = table(spark, sf_dir, "part", "p_partkey", "p_retailprice").withColumnRenamed("p_retailprice", "price")
    return integer_target(parts, "price")


@query("numeric_target", """
SELECT event_id, event_type FROM events WHERE TRY_CAST(event_type AS DOUBLE) IS NULL""")
def not_numeric(spark, sf_dir):
    return numeric_target(table(spark, sf_dir, "events", "event_id", "event_type"), "event_type")


@query("expected_row_count", """
WITH days AS (SELECT DISTINCT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT key, count(*) AS n_rows, CAST(max(day) - min(day) + 1 AS BIGINT) AS expected_rows
FROM days GROUP BY key HAVING count(*) <> max(day) - min(day) + 1""")
def row_count(spark, sf_dir):
    days = table(spark, sf_dir, "orders", "o_orderpriority", "o_orderdate").select(
        F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day")).distinct()
    return expected_row_count(days, ["key"], "day")


def _uneven(spark, sf_dir):
    """Predictions with holes: the 7-day mean lacks days without events, the 30-day mean starts late."""
    long = predictions(spark, sf_dir)
    return long.where(~((F.col("model") == "mean_7d") & (F.col("y_real") < 3))
                      & ~((F.col("model") == "mean_30d") & (F.col("target") < "2000-09-01"))).withColumn(
        "y_real", F.when((F.col("model") == "mean_30d") & (F.dayofweek("target") == 1), F.col("y_real") + 1)
        .otherwise(F.col("y_real")))


UNEVEN = PREDICTIONS + """,
uneven AS (SELECT model, horizon, origin, target, y_pred,
                  CASE WHEN model = 'mean_30d' AND dayofweek(target) = 0 THEN y_real + 1 ELSE y_real END AS y_real
           FROM preds WHERE NOT (model = 'mean_7d' AND y_real < 3)
             AND NOT (model = 'mean_30d' AND target < DATE '2000-09-01'))"""


@query("same_dates_across_models", f"""
WITH {UNEVEN} SELECT CAST(horizon AS BIGINT) AS horizon, target, count(DISTINCT model) AS models
FROM uneven GROUP BY ALL HAVING count(DISTINCT model) <> 3""")
def same_dates(spark, sf_dir):
    return rounded(same_dates_across_models(_uneven(spark, sf_dir), MODELS))


@query("prediction_coverage", f"""
WITH {UNEVEN},
grid AS (SELECT model, horizon FROM (VALUES ('persistence'), ('mean_7d'), ('mean_30d')) m(model), (VALUES (1), (3)) h(horizon)),
seen AS (SELECT model, horizon, count(*) AS n, count(DISTINCT target) AS d, min(target) AS first_target,
                max(target) AS last_target, min(origin) AS first_origin,
                count(*) FILTER (target - origin <> horizon) AS wrong_delta FROM uneven GROUP BY ALL)
SELECT grid.model, CAST(grid.horizon AS BIGINT) AS horizon, coalesce(n, 0) AS n, first_target, last_target, first_origin,
       coalesce(wrong_delta, 0) AS wrong_delta, true AS expected,
       coalesce(n = 365 AND d = 365 AND first_target = DATE '{TEST[0]}' AND last_target = DATE '{TEST[1]}'
                AND wrong_delta = 0 AND first_origin >= DATE '{TEST[0]}' - 1, false) AS ok
FROM grid LEFT JOIN seen USING (model, horizon)""")
def coverage(spark, sf_dir):
    return rounded(prediction_coverage(_uneven(spark, sf_dir), MODELS, [1, 3], *TEST, cutoff=TEST[0]))


@query("same_actuals", f"""
WITH {UNEVEN} SELECT CAST(horizon AS BIGINT) AS horizon, target, {near_sql('max(y_real) - min(y_real)')} AS spread
FROM uneven GROUP BY ALL HAVING NOT max(y_real) - min(y_real) < 1e-3""")
def same_actuals(spark, sf_dir):
    return rounded(same_actuals_across_models(_uneven(spark, sf_dir)))


@query("common_dates", f"""
WITH {UNEVEN}, shared AS (SELECT horizon, target, count(DISTINCT model) AS m FROM uneven GROUP BY ALL)
SELECT CAST(horizon AS BIGINT) AS horizon, count(*) FILTER (m = 3) AS dates FROM shared GROUP BY 1
HAVING count(*) FILTER (m = 3) <> 365""")
def shared_dates(spark, sf_dir):
    return rounded(common_dates(_uneven(spark, sf_dir), MODELS, 365))


@query("target_covers_predictions", f"""
WITH {PREDICTIONS}
SELECT DISTINCT target FROM preds
WHERE target NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem GROUP BY 1 HAVING bool_or({RARE}))""")
def uncovered(spark, sf_dir):
    have = rare_readings(spark, sf_dir).where("temp IS NOT NULL").select("day")
    return target_covers_predictions(predictions(spark, sf_dir), have)


@query("experiment_bounds", """
WITH days AS (SELECT DISTINCT c_nationkey, CAST(o_orderdate AS DATE) AS day
              FROM orders JOIN customer ON o_custkey = c_custkey),
stats AS (SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, min(day) AS first_day, max(day) AS last_day,
                 count(*) FILTER (day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31') AS train_days,
                 count(*) FILTER (day BETWEEN DATE '1997-01-15' AND DATE '1997-02-15') AS test_days
          FROM days GROUP BY 1)
SELECT * FROM stats WHERE first_day > DATE '1996-01-01' OR last_day < DATE '1997-02-15' OR train_days < 180 OR test_days < 7""")
def bounds(spark, sf_dir):
    """Nations whose daily order series are too thin to train on 1996 and test on early 1997."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    daily = daily_count(orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
                        .withColumn("day", F.to_date("o_orderdate")), ["c_nationkey"], "day")
    return rounded(experiment_bounds(daily, ["c_nationkey"], "day", "y",
                                     ("1996-01-01", "1996-12-31"), ("1997-01-15", "1997-02-15")))


@query("no_leakage", f"""
WITH {SERIES},
task AS (SELECT h AS horizon, day AS origin, day + h AS target FROM series, (VALUES (1), (3), (7), (14)) v(h)
         WHERE day + h <= (SELECT max(day) FROM series))
SELECT CAST(horizon AS BIGINT) AS horizon, max(target) FILTER (target < DATE '2000-08-05') AS last_train_target,
       min(origin) FILTER (target BETWEEN DATE '2000-08-05' AND DATE '{TEST[1]}') AS first_test_origin
FROM task GROUP BY horizon
HAVING max(target) FILTER (target < DATE '2000-08-05')
     > min(origin) FILTER (target BETWEEN DATE '2000-08-05' AND DATE '{TEST[1]}')""")
def leakage(spark, sf_dir):
    """Testing right after training leaks for every horizon above one day."""
    days = stage(series(spark, sf_dir))
    out = None
    for h in (1, 3, 7, 14):
        task = direct_task(days, [], "day", "y", h, "2000-08-05", TEST[1]).withColumn("horizon", F.lit(h))
        out = task if out is None else out.unionByName(task)
    task = out.select("horizon", "origin", "target", "split")
    return rounded(no_leakage(task.where("split = 'train'"), task.where("split = 'test'")))


# --- projections ---------------------------------------------------------------------------


@query("filter_balance", """
SELECT CAST(year(l_shipdate) AS BIGINT) AS year, CAST(month(l_shipdate) AS BIGINT) AS month, count(*) AS n FROM lineitem
WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_tax = 0.02 AND l_discount = 0.05 GROUP BY ALL""")
def balance(spark, sf_dir):
    """The filter is on the stored columns, so all four equalities reach the file."""
    chosen = equal_to({"l_returnflag": "N", "l_linestatus": "O", "l_tax": 0.02, "l_discount": 0.05})
    rows = table(spark, sf_dir, "lineitem", "l_shipdate", where=chosen)
    return rows.groupBy(F.year("l_shipdate").cast("bigint").alias("year"),
                        F.month("l_shipdate").cast("bigint").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("last_year_window", f"""
WITH {PANEL} SELECT key, day, y FROM panel p
WHERE day >= (SELECT max(day) FROM panel q WHERE q.key = p.key) - 365""")
def last_year(spark, sf_dir):
    return last_year_window(stage(panel(spark, sf_dir)), ["key"], "day")


@query("filter_year", f"WITH {SERIES} SELECT day, y FROM series WHERE year(day) = 1998")
def one_year(spark, sf_dir):
    return filter_year(series(spark, sf_dir), "day", 1998)


@query("threshold_contingency", f"""
WITH {BASE} SELECT gust > 90 AS gust_above, y > 5 AS y_above, count(*) AS n
FROM base WHERE gust IS NOT NULL AND y IS NOT NULL GROUP BY ALL""")
def contingency(spark, sf_dir):
    return threshold_contingency(base(spark, sf_dir), [], {"gust": 90, "y": 5})


@query("drop_incomplete", f"""
WITH {SPARSE} SELECT 'all' AS how, count(*) AS n FROM sparse WHERE temp IS NOT NULL OR rain IS NOT NULL
UNION ALL SELECT 'any', count(*) FROM sparse WHERE temp IS NOT NULL AND rain IS NOT NULL AND y IS NOT NULL""")
def incomplete(spark, sf_dir):
    days = sparse(spark, sf_dir)
    count = lambda df, how: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(how).alias("how"), "n")
    return count(drop_incomplete(days, "all", ["temp", "rain"]), "all").unionByName(count(drop_incomplete(days), "any"))


@query("rename_and_label", """
SELECT o_orderkey AS id, o_orderstatus AS status,
       CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' WHEN 'P' THEN 'partial' END AS label FROM orders""")
def labelled(spark, sf_dir):
    raw = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    return rename_and_label(raw, {"o_orderkey": "id", "o_orderstatus": "status"}, "status",
                            {"O": "open", "F": "filled", "P": "partial"})


@query("clip_non_negative", f"""
SELECT c_custkey, {near_sql('greatest(0, c_acctbal)')} AS balance FROM customer""")
def clipped(spark, sf_dir):
    rows = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    return rounded(rows.select("c_custkey", clip_non_negative("c_acctbal").alias("balance")))


@query("band_classify", f"""
WITH {SERIES},
banded AS (SELECT day, y * 40 AS volume FROM series)
SELECT day, CASE WHEN volume < 200 THEN '{VOLUME_BANDS[0]}' WHEN volume <= 400 THEN '{VOLUME_BANDS[1]}'
            ELSE '{VOLUME_BANDS[2]}' END AS band,
       CAST(CASE WHEN volume < 200 THEN 0 WHEN volume <= 400 THEN 1 ELSE 2 END AS BIGINT) AS band_order FROM banded""")
def bands(spark, sf_dir):
    volume = F.col("y") * 40
    return rounded(series(spark, sf_dir).select("day", band(volume).alias("band"), band_order(volume).alias("band_order")))


@query("scatter_table", f"""
WITH {SPARSE}
SELECT day, temp AS x0, {near_sql('temp')} AS x, y, CAST(year(day) AS BIGINT) AS year,
       {near_sql('percent_rank() OVER (ORDER BY day)')} AS time_rank FROM sparse""".replace("temp AS x0, ", ""))
def scatter(spark, sf_dir):
    return rounded(scatter_table(sparse(spark, sf_dir), [], "day", "temp", "y"))


@query("aligned_series", f"""
WITH {SPARSE} SELECT day, y, {near_sql('rain')} AS rain FROM sparse WHERE rain IS NOT NULL""")
def aligned(spark, sf_dir):
    return rounded(aligned_series(sparse(spark, sf_dir), [], "day", "y", "rain"))


# --- joins and calendars ---------------------------------------------------------------------


@query("calendar_null_key", """
WITH c AS (SELECT nullif(o_orderstatus, 'P') AS key, CAST(o_orderdate AS DATE) AS day, count(*) AS y FROM orders GROUP BY 1, 2),
cal AS (SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series((SELECT min(day) FROM c), (SELECT max(day) FROM c), INTERVAL 1 DAY)) AS d))
SELECT k.key, cal.day, coalesce(y, 0) AS y FROM (SELECT DISTINCT key FROM c) k CROSS JOIN cal
LEFT JOIN c ON c.key IS NOT DISTINCT FROM k.key AND c.day = cal.day""")
def null_key(spark, sf_dir):
    """Events without a key form a series of their own."""
    orders = table(spark, sf_dir, "orders", "o_orderdate", "o_orderstatus")
    events = orders.select(F.expr("nullif(o_orderstatus, 'P')").alias("key"), F.to_date("o_orderdate").alias("day"))
    return complete_calendar(daily_count(events, ["key"], "day"), ["key"], "day", {"y": 0})


@query("ingest_csv", f"""
WITH {SERIES}, hours AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem),
w AS (SELECT day, avg(l_discount * 100) AS temp, sum(l_quantity) AS rain, max(l_extendedprice) AS gust, count(*) AS n_records FROM hours GROUP BY 1)
SELECT series.day, y, {near_sql('temp')} AS temp, {near_sql('rain')} AS rain, {near_sql('gust')} AS gust, n_records
FROM series LEFT JOIN w USING (day)""")
def ingest(spark, sf_dir):
    """The raw tables written as CSV, some columns in another order, read back and built into the daily base."""
    folder = f"{checkpoint_root(spark)}/ingest-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    items = table(spark, sf_dir, "lineitem", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    hourly = items.select(F.to_date("l_shipdate").alias("day"), F.concat_ws("_", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")]).alias("hour"),
                          (F.col("l_discount") * 100).alias("t"), F.col("l_quantity").alias("r"), F.col("l_extendedprice").alias("g"))
    early = F.year("day") < 1998
    write_outputs({"events_a": orders.where("o_orderkey % 2 = 0"), "events_b": orders.where("o_orderkey % 2 <> 0").select("o_orderdate", "o_orderkey"),
                   "hours_a": hourly.where(early), "hours_b": hourly.where(~early).select("g", "r", "t", "hour", "day")}, folder, fmt="csv")
    events = unique_events(scan_events_csv(spark, [f"{folder}/events_a", f"{folder}/events_b"], "o_orderkey", "o_orderdate"), "1900-01-01", "2999-12-31", events_guard := Guard())
    read = scan_hourly_csv(spark, [f"{folder}/hours_a", f"{folder}/hours_b"], {"t": "temp", "r": "rain", "g": "gust"}, "day", "hour")
    clean = clean_hourly(read.withColumns({"wind_dir": F.lit(None).cast("double"), "wind_speed": F.lit(1.0)}), [], hours_guard := Guard())
    weather = hours_guard.stage(daily_weather(clean, []))
    # The daily counts are the write that carries the rules; the calendar reads them twice.
    counts = events_guard.stage(daily_count(events.withColumn("day", F.to_date("start")), [], "day"))
    target = stage(complete_calendar(counts, [], "day", fill={"y": 0}))
    require_one_to_one(target, weather, ["day"])
    built = stage(daily_base(target, weather, []))
    require(expected_row_count(built, [], "day"), "the daily base has gaps")
    return rounded(built.select("day", "y", "temp", "rain", "gust", "n_records"))


@query("drop_malformed", f"""
SELECT lpad(CAST(o_custkey AS VARCHAR), 14, '0') AS tax_id, CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n, {near_sql('sum(o_totalprice)')} AS value
FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 GROUP BY ALL""")
def malformed(spark, sf_dir):
    """Orders written as CSV with unreadable months and values among them; such lines are skipped, ids keep their zeros."""
    folder = f"{checkpoint_root(spark)}/malformed-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate", "o_totalprice")
    month = F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.month("o_orderdate").cast("string"))
    value = F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    lines = orders.select(
        F.lpad(F.col("o_custkey").cast("string"), 14, "0").alias("tax_id"), F.col("o_orderpriority").alias("modality"), F.col("o_orderstatus").alias("flow"),
        F.lit("item").alias("item"), F.lit("detail").alias("detail"), F.year("o_orderdate").alias("year"), month.alias("month"), value.alias("value"))
    write_outputs({"balance": lines}, folder, fmt="csv")
    read = scan_drop_malformed(spark, [f"{folder}/balance"])
    return rounded(read.groupBy("tax_id", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")))


@query("load_daily_base", f"WITH {BASE} SELECT day, y, {near_sql('temp')} AS temp, {near_sql('rain')} AS rain, n_records FROM base")
def load_base(spark, sf_dir):
    """The base is stored, its folder checked, and read back under its rules."""
    folder = f"{checkpoint_root(spark)}/base-{uuid.uuid4().hex}"
    write_outputs({"daily": base(spark, sf_dir)}, folder)
    check_stored(spark, folder, ["daily"])
    loaded = load_daily_base(spark, f"{folder}/daily", [], "day", ["y", "temp", "rain"])
    return rounded(loaded.select("day", "y", "temp", "rain", "n_records"))


@query("calendar_complete", """
WITH counts AS (SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS day, count(*) AS c FROM orders GROUP BY ALL),
cal AS (SELECT key, CAST(d AS DATE) AS day FROM (SELECT DISTINCT key FROM counts),
        (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS d FROM counts))
SELECT key, day, coalesce(c, 0) AS y FROM cal LEFT JOIN counts USING (key, day)""")
def calendar_complete(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderpriority", "o_orderdate").select(
        F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day"))
    return complete_calendar(stage(daily_count(orders, ["key"], "day")), ["key"], "day", fill={"y": 0})


@query("calendar_reindex", """
WITH counts AS (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS day, count(*) AS y FROM orders GROUP BY ALL),
cal AS (SELECT key, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
        FROM counts GROUP BY key)
SELECT key, count(*) AS days, count(y) AS known, min(day) AS first_day, max(day) AS last_day
FROM cal LEFT JOIN counts USING (key, day) GROUP BY key""")
def calendar_reindex(spark, sf_dir):
    """One series per customer, reindexed between its own first and last order."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate").select(
        F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("day"))
    days = reindex_calendar(stage(daily_count(orders, ["key"], "day")), ["key"], "day")
    return days.groupBy("key").agg(F.count(F.lit(1)).alias("days"), F.count("y").alias("known"),
                                   F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("daily_left_join", f"""
WITH {BASE} SELECT day, y, {near_sql('temp')} AS temp, {near_sql('rain')} AS rain, {near_sql('speed_mean')} AS speed_mean,
  {near_sql('speed_max')} AS speed_max, {near_sql('gust')} AS gust, n_records, {near_sql('dir_sin')} AS dir_sin,
  {near_sql('dir_cos')} AS dir_cos FROM base""")
def daily_left(spark, sf_dir):
    return rounded(base(spark, sf_dir))


@query("daily_inner_join", f"""
WITH {SPARSE} SELECT day, y, {near_sql('temp')} AS temp, {near_sql('rain')} AS rain FROM series JOIN rare USING (day)""")
def daily_inner(spark, sf_dir):
    return rounded(inner_by_day(series(spark, sf_dir), rare_readings(spark, sf_dir), []))


@query("monthly_second_source_join", f"""
WITH {SERIES},
months AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, CAST(sum(y) AS BIGINT) AS y FROM series GROUP BY 1),
bal AS (SELECT make_date(CAST(year(o_orderdate) AS INT), CAST(month(o_orderdate) AS INT), 1) AS month,
               sum(o_totalprice) / 1e6 AS consumption
        FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT month, y, {near_sql('consumption')} AS consumption FROM months JOIN bal USING (month)""")
def second_source(spark, sf_dir):
    """Filtered order value per (year, month), in millions, joined with the monthly count."""
    chosen = equal_to({"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    urgent = table(spark, sf_dir, "orders", "o_orderdate", "o_totalprice", where=chosen)
    dated = urgent.select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("mon"), "o_totalprice")
    other = monthly_balance(dated, [], "year", "mon", "o_totalprice", "consumption", 1e6)
    months = series(spark, sf_dir).groupBy(F.trunc("day", "MM").alias("month")).agg(F.sum("y").alias("y"))
    return rounded(inner_by_month(months, other, []))


@query("models_side_by_side", f"""
WITH {PREDICTIONS}
SELECT target, max(y_real) FILTER (model = 'persistence') AS y_real, """ + ", ".join(
    near_sql(f"max(y_pred) FILTER (model = '{m}')") + f" AS {m}" for m in MODELS) + " FROM preds GROUP BY target")
def side_by_side(spark, sf_dir):
    return rounded(models_side_by_side(predictions(spark, sf_dir), MODELS))


@query("left_align", f"""
WITH {UNEVEN}
SELECT p.target, {near_sql('p.y_pred')} AS persistence, {near_sql('a.y_pred')} AS mean_7d, {near_sql('b.y_pred')} AS mean_30d
FROM uneven p JOIN uneven a ON a.target = p.target AND a.model = 'mean_7d'
     JOIN uneven b ON b.target = p.target AND b.model = 'mean_30d' WHERE p.model = 'persistence'""")
def aligned_models(spark, sf_dir):
    long = _uneven(spark, sf_dir)
    one = lambda m: long.where(F.col("model") == m).select("target", F.col("y_pred").alias(m))
    return rounded(left_align(one("persistence"), [one("mean_7d"), one("mean_30d")], ["target"]))


@query("offset_join", f"""
WITH {PANEL} SELECT t.key, t.day - 7 AS origin, t.day AS target, t.y AS y_real, o.y AS y_pred
FROM panel t JOIN panel o ON o.key = t.key AND o.day = t.day - 7""")
def offset_join(spark, sf_dir):
    return at_offset(stage(panel(spark, sf_dir)), ["key"], "day", "y", 7).select(
        "key", "origin", "target", "y_real", "y_pred")


@query("missing_offsets", f"""
WITH days AS (SELECT DISTINCT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS day FROM orders),
w AS (SELECT CAST(unnest(generate_series(DATE '{COMMON_TEST[0]}', DATE '{COMMON_TEST[1]}', INTERVAL 1 DAY)) AS DATE) AS day),
need AS (SELECT key, day FROM (SELECT DISTINCT key FROM days), w UNION SELECT key, day - 14 FROM (SELECT DISTINCT key FROM days), w)
SELECT * FROM need EXCEPT SELECT * FROM days""")
def offsets_missing(spark, sf_dir):
    days = table(spark, sf_dir, "orders", "o_orderpriority", "o_orderdate").select(
        F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day")).distinct()
    return missing_offsets(stage(days), ["key"], "day", 14, *COMMON_TEST)


@query("actuals_with_predictions", f"""
WITH {UNEVEN}
SELECT CAST(horizon AS BIGINT) AS horizon, target, {near_sql('min(y_real)')} AS y_real, """ + ", ".join(
    near_sql(f"max(y_pred) FILTER (model = '{m}')") + f" AS {m}" for m in MODELS) + " FROM uneven GROUP BY horizon, target")
def actuals(spark, sf_dir):
    return rounded(actuals_with_predictions(_uneven(spark, sf_dir), MODELS))

