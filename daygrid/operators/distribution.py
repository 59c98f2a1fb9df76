"""Tables behind histograms, density curves and box plots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from daygrid.operators.blocks import attach, attach_spread
from daygrid.operators.ranks import quantiles, value_histogram

# Box-plot whiskers reach at most 1.5 interquartile ranges.
WHISKER = 1.5
# Bandwidths beyond which a kernel is below 1e-15.
REACH = 8.5


def _with_whiskers(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their counts, the group's quartiles and whether they lie inside the whiskers."""
    box = quantiles(df, group, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * WHISKER
    return (attach_spread(value_histogram(df, group, value), box, group, value)
            .withColumn("_inside", F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)))


def box_stats(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whisker ends and number of points beyond the whiskers per group."""
    v, inside = F.col(value), F.col("_inside")
    return (_with_whiskers(df, group, value).groupBy(*group)
            .agg(*[F.max(c).alias(c) for c in ("q1", "median", "q3")],
                 F.min(F.when(inside, v)).alias("whisker_low"),
                 F.max(F.when(inside, v)).alias("whisker_high"),
                 F.sum(F.when(inside, 0).otherwise(F.col("cnt"))).alias("fliers"), F.sum("cnt").alias("n")))


def fliers(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The points beyond the whiskers: each distinct value and how often it occurs."""
    return (_with_whiskers(df, group, value).where(~F.col("_inside"))
            .select(*group, value, F.col("cnt").alias("n")))


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last is closed on the right."""
    limits = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    if keys:
        placed = attach_spread(value_histogram(df, keys, value), limits, keys, value)
    else:  # the limits are one row, so every task counts its rows by bin and shuffles only the bins
        placed = attach(df.select(value).where(F.col(value).isNotNull()).withColumn("cnt", F.lit(1)), limits, [])
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    raw = F.floor(F.try_divide(F.col(value) - F.col("_lo"), width))
    return (placed.withColumn("bin", F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).cast("bigint"))
            .groupBy(*keys, "bin", "_lo", "_hi").agg(F.sum("cnt").alias("n"))
            .select(*keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("left_edge"),
                    (F.col("_lo") + (F.col("bin") + 1) * width).alias("right_edge"), "n"))


def center(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and exact median drawn beside a histogram."""
    mean = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return attach(mean, quantiles(df, keys, value, {"median": 0.5}), keys)


def density(df: DataFrame, value: str, points: int = 200, keys: Sequence[str] = ()) -> DataFrame:
    """Gaussian kernel density on a grid, exact, with Scott's bandwidth ``std * n^(-1/5)``.

    The grid reaches three bandwidths past the data.  Every distinct value is
    expanded to the grid points within ``REACH`` bandwidths, beyond which a
    kernel adds less than 1e-15, and the kernel sums combine on the map side;
    the shuffle carries ``points`` rows per series and task.
    A series without spread has no bandwidth: its grid is its only value, and
    the density is null.
    """
    stats = df.groupBy(*keys).agg(
        F.count(value).cast("double").alias("_n"), F.stddev_samp(value).alias("_sd"),
        F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    hist = value_histogram(df, keys, value).withColumnRenamed("cnt", "_cnt")
    placed = attach_spread(hist, stats, keys, value).withColumn(
        "_bw", F.col("_sd") * F.pow("_n", F.lit(-0.2))).where(F.col("_bw") > 0)
    start, stop = F.col("_lo") - 3 * F.col("_bw"), F.col("_hi") + 3 * F.col("_bw")
    step = (stop - start) / F.lit(float(points - 1))
    near = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(points - 1.0)).cast("int")
    low = near(F.ceil((F.col(value) - REACH * F.col("_bw") - start) / step).cast("double"))
    high = near(F.floor((F.col(value) + REACH * F.col("_bw") - start) / step).cast("double"))
    grid = placed.withColumn("point", F.explode(F.sequence(low, F.greatest(low, high))))
    x = start + F.col("point") * step
    z = (x - F.col(value)) / F.col("_bw")
    kernel = F.col("_cnt") * F.exp(-0.5 * z * z) / (F.col("_n") * F.col("_bw") * math.sqrt(2 * math.pi))
    reached = grid.select(*keys, F.col("point").cast("bigint").alias("point"), x.alias("x"), kernel.alias("_k"))
    # Points that no value reaches have density zero.
    bw = F.col("_sd") * F.pow("_n", F.lit(-0.2))
    first, last = F.col("_lo") - 3 * bw, F.col("_hi") + 3 * bw
    all_points = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))).alias("point")
    every = stats.where(F.col("_sd") > 0).select(*keys, first.alias("_first"), last.alias("_last"), all_points).select(
        *keys, "point", (F.col("_first") + F.col("point") * ((F.col("_last") - F.col("_first")) / F.lit(float(points - 1)))).alias("x"),
        F.lit(0.0).alias("_k"))
    spread = (reached.unionByName(every).groupBy(*keys, "point").agg(F.min("x").alias("x"), F.sum("_k").alias("density")))
    flat = (stats.where((F.col("_n") > 0) & (F.coalesce("_sd", F.lit(0.0)) <= 0))
            .select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))).alias("point"),
                    F.col("_lo").cast("double").alias("x"), F.lit(None).cast("double").alias("density")))
    return spread.unionByName(flat)
