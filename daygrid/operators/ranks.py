"""Exact order statistics without sorting a whole group in one task.

Values are first collapsed to a histogram (distinct value, count), which
combines on the map side.  Approximate percentiles of the histogram give
balanced, ordered buckets; counts are summed inside each bucket and the bucket
totals are carried over.  The result is exact: the percentiles only decide how
the work is divided.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from daygrid.operators.blocks import KEY, attach_spread, join_keys, pack_keys, unpack_keys

BUCKETS = 64


def value_histogram(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct non-null values with their counts ``cnt``; a null key is a group like any other."""
    count = F.sum(weight) if weight else F.count(F.lit(1))
    # Stated here, not left to the joins, so that every branch reads one and the same exchange.
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(count.alias("cnt"))


def running_counts(hist: DataFrame, keys: Sequence[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """Add ``before`` (rows with a smaller value) and ``total`` (rows of the group)."""
    given, keys = keys, [KEY] if keys else []
    hist = pack_keys(hist, given)
    shares = [i / buckets for i in range(1, buckets)]
    # The count takes part so that all branches read the same exchange.
    limits = hist.groupBy(*keys).agg(
        F.percentile_approx(F.when(F.col("cnt") > 0, F.col(value)), shares, F.lit(10_000)).alias("_limits"))
    below = F.filter(F.col("_limits"), lambda limit: limit < F.col(value))
    # Limits of the group itself: groups of different scale are cut into as many buckets each.
    cut = (attach_spread(hist, limits, keys, value)
           .withColumn("_bucket", F.coalesce(F.size(below), F.lit(0))).drop("_limits"))
    totals = cut.groupBy(*keys, "_bucket").agg(F.sum("cnt").alias("_sum"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bucket",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(group).alias("total"))
    inside = (Window.partitionBy(*keys, "_bucket").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    out = (cut.join(offsets, [*keys, "_bucket"])
           .withColumn("before", F.col("_offset") + F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
           .drop("_bucket", "_offset"))
    return unpack_keys(out, given)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
              buckets: int = BUCKETS, small_groups: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``.

    ``small_groups`` is for inputs with at most one row per key and day: there
    the calendar bounds a group, and the built-in aggregate may hold it.
    """
    if small_groups:
        picked = F.percentile(F.col(value), F.array(*[F.lit(float(p)) for p in probs.values()]))
        table = df.groupBy(*keys).agg(picked.alias("_q"))
        return table.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])
    ranked = running_counts(value_histogram(df, keys, value), keys, value, buckets)

    def at(index: Column) -> Column:
        holds = (F.col("before") <= index) & (index < F.col("before") + F.col("cnt"))
        return F.max(F.when(holds, F.col(value).cast("double")))

    def point(p: float) -> Column:
        return F.lit(float(p)) * (F.col("total") - 1)

    picked = ranked.groupBy(*keys).agg(*[
        a for name, p in probs.items() for a in (
            at(F.floor(point(p))).alias(f"_lo_{name}"), at(F.ceil(point(p))).alias(f"_hi_{name}"),
            F.max(point(p) - F.floor(point(p))).alias(f"_f_{name}"))])
    return picked.select(*keys, *[
        (F.col(f"_lo_{n}") + F.col(f"_f_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n)
        for n in probs])


def ranked_points(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Distinct (x, y) points with ``cnt``, the group's ``total`` and, per axis, the rows
    below (``x_before``) and the mean rank from 1 (``x_rank``).

    Ranking distinct points keeps a value shared by many rows from becoming a hot join key.
    """
    cells = out = points.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("cnt"))
    for axis in (x, y):
        ranked = running_counts(value_histogram(cells, keys, axis, "cnt"), keys, axis)
        out = join_keys(out, ranked.select(
            *keys, axis, *(["total"] if axis == x else []), F.col("before").alias(f"{axis}_before"),
            (F.col("before") + (F.col("cnt") + 1) / 2).alias(f"{axis}_rank")), keys, [axis])
    return out
