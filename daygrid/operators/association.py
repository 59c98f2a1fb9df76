"""Correlation, autocorrelation and regression tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from daygrid.functions.columns import try_pearson, unpivot
from daygrid.operators.blocks import BLOCK, block_of, over_blocks, with_position
from daygrid.operators.ranks import ranked_points


def pairs_of(cols: Sequence[str]) -> list[tuple[str, str]]:
    """Lower triangle with the diagonal."""
    return list(combinations_with_replacement(cols, 2))


def pearson(df: DataFrame, y: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(try_pearson(y, x).alias("r"))


def pearson_with(df: DataFrame, y: str, variables: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``y`` against each variable in one pass; a long table (variable, r)."""
    wide = df.groupBy(*keys).agg(*[try_pearson(y, v).alias(f"_r{i}") for i, v in enumerate(variables)])
    return unpivot(wide, list(keys), [({"variable": v}, {"r": f"_r{i}"}) for i, v in enumerate(variables)])


def pearson_matrix(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """All pairs in one pass; each pair uses the rows where both values are present."""
    pairs = pairs_of(cols)
    wide = df.groupBy(*keys).agg(*[try_pearson(a, b).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)])
    return unpivot(wide, list(keys),
                   [({"var_a": a, "var_b": b}, {"r": f"_r{i}"}) for i, (a, b) in enumerate(pairs)])


def complete_pairs(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per (var_a < var_b) and input row where both are present: x, y."""
    pairs = [(a, b) for a, b in pairs_of(cols) if a != b]
    long = unpivot(df, list(keys), [
        ({"var_a": a, "var_b": b}, {"x": f"double(`{a}`)", "y": f"double(`{b}`)"})
        for a, b in pairs])
    return long.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def spearman_matrix(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pearson on average ranks; every pair is ranked on its own complete rows."""
    group = [*keys, "var_a", "var_b"]
    ranked = ranked_points(complete_pairs(df, cols, keys), group, "x", "y")
    middle = (F.col("total") + 1) / 2
    dx, dy = F.col("x_rank") - middle, F.col("y_rank") - middle
    sums = lambda product: F.sum(F.col("cnt") * product)
    return ranked.groupBy(*group).agg(
        F.try_divide(sums(dx * dy), F.sqrt(sums(dx * dx) * sums(dy * dy))).alias("rho"))


def _tied(count: str) -> Column:
    c = F.col(count).cast("double")
    return c * (c - 1) / 2


def kendall_matrix(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), size: int = BLOCK) -> DataFrame:
    """Kendall's tau-b in O(n log n) rows, without forming pairs of rows.

    Two values of y first differ at one bit of their rank; above it they share
    a prefix.  So discordant pairs are counted per (bit, prefix) as "a one with
    a strictly smaller x before a zero": a running sum over x, cut into blocks
    whose totals are carried over.  Every point takes part once per bit, which
    also gives the ties: in x at the top bit, in y and in both at the lowest.
    """
    group = [*keys, "var_a", "var_b"]
    points = ranked_points(complete_pairs(df, cols, keys), group, "x", "y")
    top = F.length(F.bin(F.greatest(F.col("total") - 1, F.lit(1)))) - 1
    levels = points.select(*group, "cnt", F.col("x_before").alias("px"), F.col("y_before").alias("py"),
                           top.alias("top")).withColumn("bit", F.explode(F.sequence(F.lit(0), "top")))
    is_one = F.expr("shiftright(py, bit) & 1 = 1")
    sums = (levels.groupBy(*group, "top", "bit", F.expr("shiftright(py, bit + 1)").alias("prefix"), "px")
            .agg(F.sum(F.when(is_one, F.col("cnt")).otherwise(0)).alias("ones"),
                 F.sum(F.when(~is_one, F.col("cnt")).otherwise(0)).alias("zeros"))
            .withColumn("both", F.col("ones") + F.col("zeros"))
            .withColumn("_block", block_of(F.col("px"), size)))
    node = [*group, "top", "bit", "prefix"]
    before = Window.partitionBy(*node, "_block").orderBy("px").rowsBetween(Window.unboundedPreceding, -1)
    local = sums.withColumn("_seen", F.coalesce(F.sum("ones").over(before), F.lit(0)))
    blocks = local.groupBy(*node, "_block").agg(
        F.sum((F.col("zeros") * F.col("_seen")).cast("double")).alias("_inside"),
        F.sum(_tied("both")).alias("_same_x"), F.sum(_tied("ones") + _tied("zeros")).alias("_same_point"),
        F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    earlier = Window.partitionBy(*node).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_seen", F.coalesce(F.sum("ones").over(earlier), F.lit(0)))
    nodes = carried.groupBy(*node).agg(
        F.sum(F.col("_inside") + (F.col("zeros") * F.col("_seen")).cast("double")).alias("_discordant"),
        F.sum("_same_x").alias("_same_x"), F.sum("_same_point").alias("_same_point"),
        F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    at = lambda bit, value: F.sum(F.when(F.col("bit") == bit, value))
    totals = nodes.groupBy(*group).agg(
        F.sum("_discordant").alias("_d"), at(F.col("top"), F.col("_same_x")).alias("_n1"),
        at(F.lit(0), _tied("ones") + _tied("zeros")).alias("_n2"), at(F.lit(0), F.col("_same_point")).alias("_n3"),
        at(F.lit(0), F.col("ones") + F.col("zeros")).cast("double").alias("_n"))
    n0 = F.col("_n") * (F.col("_n") - 1) / 2
    concordant_less_discordant = n0 - F.col("_n1") - F.col("_n2") + F.col("_n3") - 2 * F.col("_d")
    tau = F.try_divide(concordant_less_discordant, F.sqrt((n0 - F.col("_n1")) * (n0 - F.col("_n2"))))
    return totals.select(*group, tau.alias("tau"))


def _centred(df, keys, time, cols) -> DataFrame:
    """Complete rows with closed-up positions ``_i``, centred values and the row count ``_n``."""
    rows = df.select(*keys, time, *[F.col(c).cast("double").alias(c) for c in cols]).dropna(subset=list(cols))
    placed = with_position(rows, keys, time, "_i", total="_n", means=cols)
    return placed.withColumns({c: F.col(c) - F.col(f"_mean_{c}") for c in cols})


def cross_correlation(df, keys, time, x: str, y: str, max_lag: int = 14, size: int = BLOCK) -> DataFrame:
    """``sum x[n] y[n+k] / (n sd_x sd_y)`` for k in -max_lag..max_lag; positive k: x leads.

    A row sees the next values of both series as arrays, so all lags are one pass.
    """
    base = _centred(df, keys, time, [x, y])
    wide = over_blocks(base, keys, F.col("_i"), lambda w: {
        "_x": F.collect_list(x).over(w.rowsBetween(0, max_lag)),
        "_y": F.collect_list(y).over(w.rowsBetween(0, max_lag))}, ahead=max_lag, size=size)
    lags_ = range(-max_lag, max_lag + 1)
    products = ", ".join(f"sum(`{x}` * get(_y, {k}))" if k >= 0 else f"sum(get(_x, {-k}) * `{y}`)" for k in lags_)
    # n sd_x sd_y is the root of the product of the two sums of squares.
    scale = f"sqrt(sum(`{x}` * `{x}`) * sum(`{y}` * `{y}`))"
    sums = wide.groupBy(*keys).agg(F.expr(f"array({products})").alias("_c"), F.expr(scale).alias("_scale"))
    return sums.select(*keys, "_scale", F.posexplode("_c").alias("_k", "_sum")).select(
        *keys, (F.col("_k") - max_lag).alias("lag"),
        F.try_divide(F.coalesce("_sum", F.lit(0.0)), F.col("_scale")).alias("r"))


def acf(df, keys, time, value: str, n_lags: int = 60, size: int = BLOCK) -> DataFrame:
    """Biased autocorrelation with the white-noise and the Bartlett 95% band, lag 0 to n_lags.

    Rows with a missing value are dropped and the positions closed up.  A row
    sees its next ``n_lags`` values as one array, so all lags are one pass.
    """
    base = _centred(df, keys, time, [value])
    wide = over_blocks(base, keys, F.col("_i"), lambda w: {
        "_next": F.collect_list(value).over(w.rowsBetween(0, n_lags))}, ahead=n_lags, size=size)
    products = ", ".join(f"sum(`{value}` * get(_next, {k}))" for k in range(n_lags + 1))
    sums = wide.groupBy(*keys).agg(F.max("_n").alias("_n"), F.expr(f"array({products})").alias("_c"))
    long = sums.select(*keys, "_n", F.col("_c")[0].alias("_c0"), F.posexplode("_c").alias("lag", "_sum")).select(
        *keys, "_n", "lag", F.try_divide(F.coalesce("_sum", F.lit(0.0)), F.col("_c0")).alias("acf"))
    # Bartlett: 1.96 * sqrt((1 + 2 * sum of squared acf at the smaller lags) / n); at most n_lags + 1 rows per series.
    smaller = Window.partitionBy(*keys, "_n").orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    past = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(smaller), F.lit(0.0))
    bartlett = F.when(F.col("lag") == 0, F.lit(0.0)).otherwise(F.lit(1.96) * F.sqrt((1 + 2 * past) / F.col("_n")))
    return long.select(
        *keys, F.col("lag").cast("bigint").alias("lag"), "acf", (F.lit(1.96) / F.sqrt("_n")).alias("band"),
        bartlett.alias("bartlett"), F.col("_n").cast("bigint").alias("n"))


def pacf(df, keys, time, value: str, n_lags: int = 60) -> DataFrame:
    """Partial autocorrelation (Yule-Walker): Levinson recursion on the n_lags + 1 numbers of a series."""
    table = acf(df, keys, time, value, n_lags).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda s: s.acf).alias("r"))

    return table.select(*keys, F.posexplode(_levinson("r")).alias("lag", "pacf")).select(
        *keys, F.col("lag").cast("bigint").alias("lag"), "pacf")


def _small_functions():
    """The two scalar recursions, made here so that they travel to the workers by value.

    Module-level functions would be sent by name, and the workers would need
    this package installed.
    """

    def partial(r) -> list[float | None]:
        """Durbin's recursion on one short autocorrelation sequence."""
        if any(v is None or not math.isfinite(v) for v in r):
            return [None] * len(r)
        out, phi, error = [1.0], np.zeros(0), 1.0
        for k in range(1, len(r)):
            past = np.asarray(r[1:k][::-1], dtype=float)
            step = (r[k] - phi @ past) / error
            phi = np.append(phi - step * phi[::-1], step)
            error *= 1.0 - step * step
            out.append(float(step))
        return out

    def upper(q: float, df: int) -> float:
        """Upper tail of chi-squared for whole degrees of freedom, in closed form."""
        x = q / 2.0
        if df % 2 == 0:
            term = total = math.exp(-x)
            for i in range(1, df // 2):
                term *= x / i
                total += term
            return total
        total = math.erfc(math.sqrt(x))
        term = math.exp(-x) * math.sqrt(x) / math.gamma(1.5)
        for i in range(1, (df + 1) // 2):
            total += term
            term *= x / (i + 0.5)
        return total

    return partial, upper


partial_from_acf, chi2_upper = _small_functions()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _levinson(rows: pd.Series) -> pd.Series:
    return rows.map(partial_from_acf)


@F.pandas_udf(T.DoubleType())
def chi2_upper_column(q: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else chi2_upper(float(a), int(b)) for a, b in zip(q, df)], dtype="float64")


def ljung_box_statistic(h: int) -> Column:
    """Aggregate over the rows of one series in an :func:`acf` table."""
    n, lag = F.col("n").cast("double"), F.col("lag")
    return F.sum(F.when(lag.between(1, h), n * (n + 2) * F.col("acf") * F.col("acf") / (n - lag)))


def ljung_box(acf_table: DataFrame, keys: Sequence[str], lags_: Sequence[int] = (7, 14)) -> DataFrame:
    """Ljung-Box statistic and p-value at the given lags from an :func:`acf` table."""
    sums = acf_table.groupBy(*keys).agg(*[ljung_box_statistic(h).alias(f"_q{h}") for h in lags_])
    long = unpivot(sums, list(keys), [({"lag": h}, {"q": f"_q{h}"}) for h in lags_])
    return long.select(*keys, F.col("lag").cast("bigint").alias("lag"), "q",
                       chi2_upper_column("q", "lag").alias("p_value"))


def linear_fit(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and R² on complete pairs; null with under two points or no variance."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    sxx, syy, sxy = F.regr_sxx(a, b), F.regr_syy(a, b), F.regr_sxy(a, b)
    slope = F.try_divide(sxy, sxx)
    return df.groupBy(*keys).agg(
        F.regr_count(a, b).alias("n"), slope.alias("slope"),
        (F.regr_avgy(a, b) - slope * F.regr_avgx(a, b)).alias("intercept"),
        F.try_divide(sxy * sxy, sxx * syy).alias("r2"))


def top_correlations(table: DataFrame, r: str = "r", n: int = 12, ties: Sequence[str] = ()) -> DataFrame:
    """The n strongest rows by absolute value."""
    return table.where(F.col(r).isNotNull()).orderBy(F.abs(F.col(r)).desc(), *ties).limit(n)


def ordered_labels(table: DataFrame, label: str, r: str = "r") -> DataFrame:
    """Labels by their largest absolute correlation over all scales."""
    return (table.groupBy(label).agg(F.max(F.abs(F.col(r))).alias("strength"))
            .orderBy(F.col("strength").desc(), label))
