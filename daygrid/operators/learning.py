"""Splits, folds and scalers; everything is fitted on training rows only."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from daygrid.operators.blocks import attach, with_position
from daygrid.operators.windows import lead_target, lead_targets


def split_by_fraction(df, keys, time, fraction: float = 0.8) -> DataFrame:
    """First ``floor(fraction * n)`` rows of each series are ``train``, the rest ``test``."""
    placed = with_position(df, keys, time, "_i", total="_n")
    n_train = F.floor(F.col("_n") * F.lit(float(fraction)))
    return (placed.withColumn("split", F.when(F.col("_i") < n_train, "train").otherwise("test"))
            .drop("_i", "_n"))


def split_last_rows(df, keys, time, rows: int = 365) -> DataFrame:
    """The last ``rows`` rows of each series are ``test``."""
    placed = with_position(df, keys, time, "_i", total="_n")
    is_test = F.col("_i") >= F.col("_n") - rows
    return placed.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("_i", "_n")


def _date(value) -> Column:
    return F.lit(str(value)).cast("date")


def split_by_target_date(df: DataFrame, test_start, test_end, train_start=None, train_end=None,
                         target: str = "target") -> DataFrame:
    """Train and test by target date, not origin; rows in neither part are dropped."""
    t = F.col(target)
    train = t <= _date(train_end) if train_end is not None else t < _date(test_start)
    if train_start is not None:
        train = train & (t >= _date(train_start))
    test = t.between(_date(test_start), _date(test_end))
    return (df.withColumn("split", F.when(test, "test").when(train, "train"))
            .where(F.col("split").isNotNull()))


def multi_horizon_task(df, keys, time, value, horizons: Sequence[int], test_start, test_end, train_start=None, train_end=None) -> DataFrame:
    """One row per origin with ``label_<h>`` and ``split_<h>`` per horizon; the split is that of the target date.

    A horizon without a label, or whose target lies in neither part, has a null split.
    Origins without any split are dropped.
    """
    task = lead_targets(df, keys, time, value, horizons).withColumnRenamed(time, "origin")
    lo, hi = _date(test_start), _date(test_end)
    for h in horizons:
        t, known = F.date_add("origin", h), F.col(f"label_{h}").isNotNull()
        train = t <= _date(train_end) if train_end is not None else t < lo
        if train_start is not None:
            train = train & (t >= _date(train_start))
        task = task.withColumn(f"split_{h}", F.when(known & t.between(lo, hi), "test").when(known & train, "train"))
    return task.where(F.coalesce(*[F.col(f"split_{h}") for h in horizons]).isNotNull())


def require_both_parts(task: DataFrame, split: str = "split") -> None:
    """Raise if the training or the test part is empty."""
    found = {r[0] for r in task.where(F.col(split).isNotNull()).select(split).distinct().collect()}
    if missing := {"train", "test"} - found:
        raise ValueError(f"no rows in {split}: {', '.join(sorted(missing))}")


def split_by_cut_date(df: DataFrame, time: str, cut) -> DataFrame:
    return df.withColumn("split", F.when(F.col(time) < _date(cut), "train").otherwise("test"))


def _train(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train")


def fitted_rows(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """What statistics of the training rows were fitted on: (keys, first_day, last_day, rows); kept beside them."""
    return _train(df).groupBy(*keys).agg(
        F.min(time).alias("first_day"), F.max(time).alias("last_day"), F.count(F.lit(1)).alias("rows"))


def minmax_stats(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return _train(df).groupBy(*keys).agg(*[
        a for c in cols for a in (F.min(c).cast("double").alias(f"_lo_{c}"), F.max(c).cast("double").alias(f"_hi_{c}"))])


def _range(c: str) -> Column:
    width = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
    return F.when(width == 0, F.lit(1.0)).otherwise(width)


def minmax_scale(df: DataFrame, keys: Sequence[str], cols: Sequence[str], keep_stats: bool = False) -> DataFrame:
    """To [0, 1] on the training rows; a constant column becomes 0.  Test rows may leave the range."""
    scaled = attach(df, minmax_stats(df, keys, cols), keys).withColumns(
        {c: (F.col(c) - F.col(f"_lo_{c}")) / _range(c) for c in cols})
    return scaled if keep_stats else scaled.drop(*[f"_{s}_{c}" for c in cols for s in ("lo", "hi")])


def minmax_inverse(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Undo :func:`minmax_scale` (``keep_stats=True``)."""
    return df.withColumns({c: F.col(c) * _range(c) + F.col(f"_lo_{c}") for c in cols}).drop(
        *[f"_{s}_{c}" for c in cols for s in ("lo", "hi")])


def _scaled(df, keys, cols, deviation, missing_is_one: bool) -> DataFrame:
    stats = _train(df).groupBy(*keys).agg(*[
        a for c in cols for a in (F.avg(c).alias(f"_m_{c}"), deviation(c).alias(f"_sd_{c}"))])

    def unit(c: str) -> Column:
        sd = F.nullif(F.col(f"_sd_{c}"), F.lit(0.0))
        return F.coalesce(sd, F.lit(1.0)) if missing_is_one else F.when(F.col(f"_sd_{c}") == 0, 1.0).otherwise(F.col(f"_sd_{c}"))

    return (attach(df, stats, keys)
            .withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / unit(c) for c in cols})
            .drop(*[f"_{s}_{c}" for c in cols for s in ("m", "sd")]))


def standardize(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean 0 and population deviation 1 on the training rows; zero deviation counts as 1."""
    return _scaled(df, keys, cols, F.stddev_pop, False)


def zscore(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """As :func:`standardize` with the sample deviation; zero or missing deviation counts as 1."""
    return _scaled(df, keys, cols, F.stddev_samp, True)


def feature_groups(columns: Sequence[str], rules: Mapping[str, Callable[[str], bool]]) -> dict[str, list[str]]:
    """Columns by the group whose rule accepts them; each column must have exactly one."""
    accepted = {c: [group for group, rule in rules.items() if rule(c)] for c in columns}
    odd = {c: found for c, found in accepted.items() if len(found) != 1}
    if odd:
        raise ValueError(f"columns without exactly one group: {odd}")
    return {group: [c for c in columns if accepted[c] == [group]] for group in rules}


def time_series_folds(df, keys, time, n_splits: int = 5) -> DataFrame:
    """Expanding folds: test size ``n div (n_splits + 1)``, training is every earlier row.

    One output row per (fold, row) with its ``role``; rows after a fold's test
    part do not appear in it.
    """
    placed = with_position(df, keys, time, "_i", total="_n")
    size = F.floor(F.col("_n") / (n_splits + 1))
    exploded = placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    start = F.col("_n") - (n_splits - F.col("fold")) * size
    role = F.when(F.col("_i") < start, "train").when(F.col("_i") < start + size, "test")
    return (exploded.withColumn("role", role).where(F.col("role").isNotNull())
            .withColumn("fold", F.col("fold").cast("bigint")).drop("_i", "_n"))


def common_folds(df: DataFrame, time: str, n_splits: int = 5) -> DataFrame:
    """(time, fold, role) of every distinct date: folds for a model that is pooled over series."""
    return time_series_folds(df.select(time).distinct(), [], time, n_splits)


def direct_task(df, keys, time, value, horizon: int, test_start, test_end, train_start=None, train_end=None) -> DataFrame:
    """Features at t, label y[t+h], split by target date."""
    task = lead_target(df, keys, time, value, horizon).withColumnRenamed(time, "origin")
    return split_by_target_date(task, test_start, test_end, train_start, train_end)
