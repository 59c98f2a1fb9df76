"""Correlation, autocorrelation and regression."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from daygrid.catalog.registry import (
    BASE, PANEL, PREDICTIONS, SPARSE, base, near, near_sql, panel, predictions, query, rounded, sparse, stage, table)
from daygrid.catalog.rollups import _MONTH, _WEEK_MON, DIRECTION
from daygrid.operators.association import (
    acf, cross_correlation, kendall_matrix, linear_fit, ljung_box, ordered_labels, pacf, pearson_matrix, pearson_with,
    spearman_matrix, top_correlations)
from daygrid.operators.evaluate import error_trend, pivot_metric
from daygrid.operators.quality import numeric_columns
from daygrid.operators.shape import monthly_balance
from daygrid.plans.experiment import correlation_table

VARIABLES = ("temp", "rain", "speed_mean", "speed_max", "gust", "dir_sin", "dir_cos")
# Display names of the variables.
LABELS = {"temp": "Temperatura média", "rain": "Precipitação total", "speed_mean": "Velocidade média do vento",
          "speed_max": "Velocidade máxima do vento", "gust": "Rajada máxima", "dir_sin": "Direção do vento (seno)",
          "dir_cos": "Direção do vento (cosseno)", "consumption": "Consumo total"}

_SCALES = BASE + "".join(f""",
{name} AS (SELECT {label} AS bin, sum(y) AS y, sum(rain) AS rain, avg(temp) AS temp, avg(speed_mean) AS speed_mean,
  max(speed_max) AS speed_max, max(gust) AS gust, avg(dir_sin) AS s, avg(dir_cos) AS c FROM base GROUP BY 1),
{name}s AS (SELECT *, CASE WHEN sqrt(s*s+c*c) >= 1e-12 THEN s / sqrt(s*s+c*c) END AS dir_sin,
  CASE WHEN sqrt(s*s+c*c) >= 1e-12 THEN c / sqrt(s*s+c*c) END AS dir_cos FROM {name})"""
    for name, label in (("week", _WEEK_MON), ("month", _MONTH))) + """,
bal AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bin, sum(o_totalprice) / 1e6 AS consumption
        FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"""


def _corr(a: str, b: str) -> str:
    return near_sql(f"CASE WHEN isfinite(corr({a}, {b})) THEN corr({a}, {b}) END", 5)


_TABLE = _SCALES + ", tab AS (" + " UNION ALL ".join(
    f"SELECT '{scale}' AS scale, '{v}' AS variable, {_corr('y', v)} AS r, '{LABELS[v]}' AS label FROM {source}"
    for scale, source in (("day", "base"), ("week", "weeks"), ("month", "months")) for v in VARIABLES) + f"""
UNION ALL SELECT 'month', 'consumption', {_corr('y', 'consumption')}, '{LABELS['consumption']}' FROM months JOIN bal USING (bin))"""


def _correlations(spark, sf_dir):
    dated = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("mon"), "o_totalprice")
    other = monthly_balance(dated, [], "year", "mon", "o_totalprice", "consumption", 1e6)
    out = correlation_table(base(spark, sf_dir), [], "day", VARIABLES, LABELS, DIRECTION, (other, "consumption"))
    return rounded(out, 5)


@query("pearson_by_scale", f"WITH {_TABLE} SELECT * FROM tab")
def by_scale(spark, sf_dir):
    return _correlations(spark, sf_dir)


@query("top_correlations", f"WITH {_TABLE} SELECT * FROM tab ORDER BY abs(r) DESC, scale, variable LIMIT 12")
def strongest(spark, sf_dir):
    return top_correlations(_correlations(spark, sf_dir), ties=["scale", "variable"])


@query("correlation_pivot", f"""
WITH {_TABLE} SELECT label, max(abs(r)) AS strength, max(r) FILTER (scale = 'day') AS day, max(r) FILTER (scale = 'week') AS week,
  max(r) FILTER (scale = 'month') AS month FROM tab GROUP BY label""")
def correlation_pivot(spark, sf_dir):
    long = stage(_correlations(spark, sf_dir))
    return ordered_labels(long, "label").join(pivot_metric(long, ["label"], "scale", ["day", "week", "month"], "r"), "label")


@query("pearson_by_key", f"""
WITH {PANEL}, d AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS key, avg(o_totalprice) AS price,
                           max(o_totalprice) AS top FROM orders GROUP BY ALL)
SELECT key, 'price' AS variable, {_corr('y', 'price')} AS r FROM panel JOIN d USING (key, day) GROUP BY key
UNION ALL SELECT key, 'top', {_corr('y', 'top')} FROM panel JOIN d USING (key, day) GROUP BY key""")
def by_key(spark, sf_dir):
    prices = (table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day"))
              .agg(F.avg("o_totalprice").alias("price"), F.max("o_totalprice").alias("top")))
    return rounded(pearson_with(panel(spark, sf_dir).join(prices, ["key", "day"]), "y", ["price", "top"], ["key"]), 5)


_MATRIX = ("y", "temp", "rain", "gust")


@query("pearson_matrix", f"WITH {BASE} " + " UNION ALL ".join(
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, {_corr(a, b)} AS r FROM base"
    for i, a in enumerate(_MATRIX) for b in _MATRIX[i:]))
def matrix(spark, sf_dir):
    return rounded(pearson_matrix(base(spark, sf_dir), _MATRIX), 5)


def _ranked(a: str, b: str, source: str) -> str:
    mean_rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return f"(SELECT {mean_rank(a)} AS rx, {mean_rank(b)} AS ry FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


@query("spearman_matrix", f"WITH {SPARSE}, s AS (SELECT y, temp, rain, dayofyear(day) AS season FROM sparse) " + " UNION ALL ".join(
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, {_corr('ry', 'rx')} AS rho FROM {_ranked(a, b, 's')}"
    for a, b in combinations(("y", "temp", "rain", "season"), 2)))
def spearman(spark, sf_dir):
    rows = sparse(spark, sf_dir).withColumn("season", F.dayofyear("day"))
    return rounded(spearman_matrix(rows, ["y", "temp", "rain", "season"]), 5)


@query("spearman_parts", f"SELECT 'p_size' AS var_a, 'p_retailprice' AS var_b, {_corr('ry', 'rx')} AS rho FROM "
       + _ranked("p_size", "p_retailprice", "part"))
def spearman_parts(spark, sf_dir):
    """Ranks over the whole part table."""
    return rounded(spearman_matrix(table(spark, sf_dir, "part", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]), 5)


def _kendall(a: str, b: str, source: str) -> str:
    """Sign sums over all pairs of distinct points."""
    return f"""
SELECT '{a}' AS var_a, '{b}' AS var_b, {near_sql('''CASE WHEN sum(p.c * q.c * (sx * sx)) > 0 AND sum(p.c * q.c * (sy * sy)) > 0
  THEN sum(p.c * q.c * sx * sy) / sqrt(CAST(sum(p.c * q.c * sx * sx) AS DOUBLE) * sum(p.c * q.c * sy * sy)) END''', 5)} AS tau
FROM (SELECT {a} AS x, {b} AS y, count(*) AS c FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL) p,
     (SELECT {a} AS x2, {b} AS y2, count(*) AS c FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL) q,
     LATERAL (SELECT CASE WHEN x2 > x THEN 1 WHEN x2 < x THEN -1 ELSE 0 END AS sx,
                     CASE WHEN y2 > y THEN 1 WHEN y2 < y THEN -1 ELSE 0 END AS sy) s"""


@query("kendall_matrix", f"WITH {BASE} " + " UNION ALL ".join(
    _kendall(a, b, "base") for a, b in combinations(("y", "temp", "rain"), 2)))
def kendall(spark, sf_dir):
    return rounded(kendall_matrix(base(spark, sf_dir), ["y", "temp", "rain"]), 5)


_NUMBERS = ("y", "temp", "rain", "speed_mean", "speed_max", "gust", "n_records", "dir_sin", "dir_cos")


@query("pearson_matrix_all", f"WITH {BASE} " + " UNION ALL ".join(
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, {_corr(a, b)} AS r FROM base"
    for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i:]))
def every_pearson(spark, sf_dir):
    """Every numeric column of the base with every other."""
    days = base(spark, sf_dir)
    return rounded(pearson_matrix(days, numeric_columns(days)), 5)


@query("spearman_matrix_all", f"WITH {BASE} " + " UNION ALL ".join(
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, {_corr('ry', 'rx')} AS rho FROM {_ranked(a, b, 'base')}" for a, b in combinations(_NUMBERS, 2)))
def every_spearman(spark, sf_dir):
    days = base(spark, sf_dir)
    return rounded(spearman_matrix(days, numeric_columns(days)), 5)


@query("cross_correlation", f"""
WITH {BASE}, n AS (SELECT CAST(rain AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, row_number() OVER (ORDER BY day) AS i
                   FROM base WHERE rain IS NOT NULL),
m AS (SELECT avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, count(*) AS n FROM n),
k AS (SELECT unnest(generate_series(-14, 14)) AS lag)
SELECT CAST(lag AS BIGINT) AS lag, {near_sql('sum((a.x - mx) * (b.y - my)) / (any_value(n) * any_value(sx) * any_value(sy))')} AS r
FROM k, m, n a JOIN n b ON b.i = a.i + lag GROUP BY lag""")
def cross(spark, sf_dir):
    return rounded(cross_correlation(base(spark, sf_dir), [], "day", "rain", "y"))


_ACF = """n AS (SELECT key, CAST(y AS DOUBLE) AS v, row_number() OVER (PARTITION BY key ORDER BY day) AS i FROM panel),
m AS (SELECT key, avg(v) AS mean, var_pop(v) * count(*) AS ss, count(*) AS n FROM n GROUP BY key),
k AS (SELECT unnest(generate_series(0, 60)) AS lag),
acf AS (SELECT a.key, lag, sum((a.v - mean) * (b.v - mean)) / any_value(ss) AS acf, any_value(m.n) AS n
        FROM k, m JOIN n a ON a.key = m.key JOIN n b ON b.key = a.key AND b.i = a.i + lag GROUP BY a.key, lag)"""


@query("acf", f"""
WITH {PANEL}, {_ACF}
SELECT key, CAST(lag AS BIGINT) AS lag, {near_sql('acf')} AS acf, {near_sql('1.96 / sqrt(n)')} AS band, n,
       {near_sql('CASE WHEN lag = 0 THEN 0 ELSE 1.96 * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN acf * acf END) OVER w, 0)) / n) END')} AS bartlett
FROM acf WINDOW w AS (PARTITION BY key ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def autocorrelation(spark, sf_dir):
    return rounded(acf(stage(panel(spark, sf_dir)), ["key"], "day", "y"))


@query("pacf", f"""
WITH RECURSIVE {PANEL}, {_ACF},
lists AS (SELECT key, list(acf ORDER BY lag) AS r FROM acf GROUP BY key),
durbin AS (
  SELECT key, 1 AS k, [r[2]] AS phi, 1 - r[2] * r[2] AS err, r[2] AS step, r FROM lists
  UNION ALL
  SELECT key, k + 1, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - new * phi[k + 1 - i]), new),
         err * (1 - new * new), new, r
  FROM (SELECT *, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[k + 2 - i]))) / err AS new
        FROM durbin WHERE k < 60))
SELECT key, CAST(0 AS BIGINT) AS lag, {near_sql('1')} AS pacf FROM lists
UNION ALL SELECT key, CAST(k AS BIGINT), {near_sql('step')} FROM durbin""")
def partial(spark, sf_dir):
    return rounded(pacf(stage(panel(spark, sf_dir)), ["key"], "day", "y"))


_GAMMA_TAIL = """1 - (SELECT sum(exp(-q / 2 + (h / 2.0 + j) * ln(q / 2) - lgamma(h / 2.0 + j + 1)))
                     FROM range(400) t(j))"""


@query("ljung_box", f"""
WITH {PANEL}, {_ACF},
lb AS (SELECT key, h, any_value(n) * (any_value(n) + 2.0) * sum(acf * acf / (n - lag)) AS q
       FROM acf, (VALUES (7), (14)) v(h) WHERE lag BETWEEN 1 AND h GROUP BY key, h)
SELECT key, CAST(h AS BIGINT) AS lag, {near_sql('q')} AS q, {near_sql(_GAMMA_TAIL, 7)} AS p_value FROM lb""")
def portmanteau(spark, sf_dir):
    tests = ljung_box(acf(stage(panel(spark, sf_dir)), ["key"], "day", "y", 14), ["key"])
    return tests.select("key", "lag", near("q").alias("q"), near("p_value", 7).alias("p_value"))


def _fit(x: str, y: str, digits: int = 6) -> str:
    return f"""CAST(regr_count({y}, {x}) AS BIGINT) AS n,
 {near_sql(f'CASE WHEN regr_sxx({y}, {x}) > 0 THEN regr_slope({y}, {x}) END', digits)} AS slope,
 {near_sql(f'CASE WHEN regr_sxx({y}, {x}) > 0 THEN regr_intercept({y}, {x}) END', digits)} AS intercept,
 {near_sql(f'CASE WHEN regr_sxx({y}, {x}) > 0 AND regr_syy({y}, {x}) > 0 THEN regr_r2({y}, {x}) END', digits)} AS r2"""


@query("linear_fit_by_year", f"""
WITH {BASE} SELECT CAST(year(day) AS BIGINT) AS year, {_fit('rain', 'CAST(y AS DOUBLE)')} FROM base GROUP BY 1""")
def fit_by_year(spark, sf_dir):
    rows = base(spark, sf_dir).withColumn("year", F.year("day").cast("bigint"))
    return rounded(linear_fit(rows, "rain", "y", ["year"]))


@query("linear_fit_single_points", f"""
SELECT p_brand, p_type, p_size, {_fit('CAST(p_partkey AS DOUBLE)', 'p_retailprice', 4)}
FROM (SELECT p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice, p_partkey FROM part) GROUP BY ALL""")
def fit_small_groups(spark, sf_dir):
    """Many groups have one point or no variance: null, not an error."""
    return rounded(linear_fit(table(spark, sf_dir, "part"), "p_partkey", "p_retailprice", ["p_brand", "p_type", "p_size"]), 4)


@query("error_trend", f"""
WITH {PREDICTIONS}, r AS (SELECT model, y_real, abs(y_real - y_pred) AS e FROM preds) SELECT model, {_fit('y_real', 'e')} FROM r GROUP BY model""")
def trend_of_errors(spark, sf_dir):
    return rounded(error_trend(predictions(spark, sf_dir)))

