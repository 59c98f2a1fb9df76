"""Circular block bootstrap of mean errors.

The mean of a resample is a sum of block sums, and a block sum is a difference
of two running sums.  So a resample needs only its block starts and the running
sums of the series; the resampled series itself is never built.  All models and
all pairs share the same starts (a paired design).

A series is shuffled once and stays where it is: its running sums are closed for
the longest block and serve all block lengths, and the resamples are drawn beside
them.  The digests behind the starts depend on (seed, resample, block) alone, so a
task computes them once for all of its series, whatever their lengths.

Defined results: one row per date and series, a repeated date is an error; missing
errors add nothing to a sum but keep their place; a null key is a series like any
other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from daygrid.functions.columns import unpivot

# Resamples drawn together: bounds the arrays of a long series.
CHUNK = 250
# Digests a task keeps for its next series (32 MB); those beyond are computed again.
MOST_KEPT = 1 << 22
# Two-sided 95% percentile interval.
INTERVAL = (0.025, 0.975)


def block_start(seed: Column, resample: Column, block: Column, n: Column) -> Column:
    """A reproducible start in [0, n): the first 48 bits of an md5 digest, modulo n."""
    text = F.concat_ws(":", seed, resample, block)
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint"), n)


def block_size(block: Column, n: Column, block_length: int) -> Column:
    """Every block has the full length but the last, which is cut so that the sizes add up to n."""
    return F.least(F.lit(block_length).cast("bigint"), n - block * F.lit(block_length))


def _check_sizes(resamples: int, block_length: int) -> None:
    if resamples <= 0 or block_length <= 0:
        raise ValueError("bootstrap sizes must be positive")


def block_starts(lengths: DataFrame, resamples: int, block_length: int, seed: int = 42) -> DataFrame:
    """Starts for every distinct series length ``n``: (n, resample, block, start, size)."""
    _check_sizes(resamples, block_length)
    n, block = F.col("n"), F.col("block")
    return (lengths.select("n").where(n > 0).distinct()
            .withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
            .repartition("n", "resample")
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(n / block_length) - 1)))
            .withColumn("start", block_start(F.lit(seed), F.col("resample"), block, n))
            .withColumn("size", block_size(block, n, block_length)))


def block_indices(lengths: DataFrame, resamples: int, block_length: int, seed: int = 42) -> DataFrame:
    """The index sequence itself: (n, resample, place, index); for inspection and tests."""
    starts = block_starts(lengths, resamples, block_length, seed)
    return (starts.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1)))
            .select("n", "resample", (F.col("block") * block_length + F.col("_o")).alias("place"),
                    F.pmod(F.col("start") + F.col("_o"), F.col("n")).alias("index")))


def _resampler(keys, time, values, resamples, lengths, seed, summary, rooted):
    """The function of one series; it names nothing of this package, which workers need not hold.

    ``summary`` gives one row per block length with point and interval of every
    value, otherwise one row per resample.
    """
    chunk, most, levels, kept = CHUNK, MOST_KEPT, INTERVAL, {}

    def digests(first, last, blocks):
        import hashlib

        import numpy as np

        known = kept.get(first)
        have = 0 if known is None else known.shape[1]
        if have < blocks:
            more = np.array([[int.from_bytes(hashlib.md5(b"%d:%d:%d" % (seed, r, b)).digest()[:6], "big") for b in range(have, blocks)]
                             for r in range(first, last)], dtype=np.int64)
            known = more if known is None else np.concatenate([known, more], axis=1)
            if sum(d.size for at, d in kept.items() if at != first) + known.size <= most:
                kept[first] = known
        return known[:, :blocks]

    def run(series):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        series = series.sort_by(time).combine_chunks()
        n, at = series.num_rows, series[time]
        if pc.any(pc.equal(at.slice(1), at.slice(0, n - 1))).as_py():
            raise ValueError("bootstrap: a date occurs twice in a series")
        again = min(max(lengths), n)
        sums = []
        for v in values:
            e = series[v].fill_null(0.0).to_numpy()
            sums.append(np.concatenate([[0.0], np.cumsum(np.concatenate([e, e[:again]]))]))
        parts = []
        for length in lengths:
            blocks = -(-n // length)
            sizes = np.minimum(length, n - length * np.arange(blocks))
            means = np.empty((len(values), resamples))
            for first in range(0, resamples, chunk):
                last = min(first + chunk, resamples)
                start = digests(first, last, blocks) % n
                stop = start + sizes
                for i, total in enumerate(sums):
                    means[i, first:last] = (total[stop] - total[start]).sum(axis=1) / n
            rows = 1 if summary else resamples
            own = series.select(keys).take(pa.array(np.zeros(rows, dtype=np.int64))).columns if keys else []
            columns = [*own, pa.array(np.full(rows, n, dtype=np.int64))]
            if not summary:
                parts.append(pa.table([*columns, pa.array(np.arange(rows, dtype=np.int32)), *[pa.array(m) for m in means]], names=names))
                continue
            columns.append(pa.array([length], pa.int64()))
            for v, m in zip(values, means):
                point = pc.mean(series[v]).as_py()
                if v in rooted:
                    m, point = np.sqrt(np.maximum(m, 0.0)), None if point is None else point ** 0.5
                low, high = np.percentile(m, [100 * p for p in levels])
                columns += [pa.array([point], pa.float64()), pa.array([low]), pa.array([high])]
            parts.append(pa.table(columns, names=names))
        return pa.concat_tables(parts)

    names = [*keys, "n", *(["block_days", *[f"{v}{end}" for v in values for end in ("", "_low", "_high")]] if summary else ["resample", *values])]
    return run, names


def _by_series(errors: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], resamples: int,
               lengths: Sequence[int], seed: int, summary: bool, rooted: Sequence[str] = ()) -> DataFrame:
    for length in lengths:
        _check_sizes(resamples, length)
    rows = errors.select(*keys, time, *[F.col(v).cast("double").alias(v) for v in values])
    run, names = _resampler(list(keys), time, list(values), resamples, [int(x) for x in lengths], seed, summary, frozenset(rooted))
    kinds = {"n": T.LongType(), "block_days": T.LongType(), "resample": T.IntegerType()}
    schema = T.StructType([rows.schema[c] if c in keys else T.StructField(c, kinds.get(c, T.DoubleType())) for c in names])
    return rows.groupBy(*keys).applyInArrow(run, schema)


def bootstrap_means(errors: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], resamples: int,
                    block_length: int, seed: int = 42) -> DataFrame:
    """Mean of every value column in every resample: (keys, n, resample, values).

    ``errors`` has one complete row per series and date, which bounds a group.  A
    series shorter than a block is resampled as one block cut to its own length.
    """
    return _by_series(errors, keys, time, values, resamples, [block_length], seed, summary=False)


def bootstrap_summary(errors: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], resamples: int,
                      block_lengths: Sequence[int], seed: int = 42, rooted: Sequence[str] = ()) -> DataFrame:
    """(keys, n, block_days) and per value its mean and 95% interval (``v``, ``v_low``, ``v_high``).

    Values in ``rooted`` are reported as roots of their means.
    """
    return _by_series(errors, keys, time, values, resamples, block_lengths, seed, True, rooted)


def bootstrap_intervals(wide: DataFrame, models: Sequence[str], keys: Sequence[str] = (), time: str = "target",
                        resamples: int = 10_000, block_length: int = 7, seed: int = 42) -> DataFrame:
    """95% intervals of MAE, RMSE and bias per model from a side-by-side table (y_real, one column per model)."""
    e = {m: F.col("y_real") - F.col(m) for m in models}
    rows = wide.select(*keys, time, *[c for i, m in enumerate(models) for c in (
        F.abs(e[m]).alias(f"mae{i}"), (e[m] * e[m]).alias(f"rmse{i}"), e[m].alias(f"bias{i}"))])
    values = [f"{kind}{i}" for i in range(len(models)) for kind in ("mae", "rmse", "bias")]
    found = bootstrap_summary(rows, keys, time, values, resamples, [block_length], seed,
                              rooted=[f"rmse{i}" for i in range(len(models))])
    return unpivot(found, list(keys), [({"model": m}, {"n": "n"} | {
        f"{kind}{end}": f"{kind}{i}{end}" for kind in ("mae", "rmse", "bias") for end in ("", "_low", "_high")})
        for i, m in enumerate(models)])


def block_sensitivity(wide: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = (),
                      time: str = "target", resamples: int = 10_000, block_lengths: Sequence[int] = (7, 14, 30),
                      seed: int = 42) -> DataFrame:
    """Paired MAE differences a - b with intervals for several block lengths, from one pass; a negative value favours a."""
    loss = lambda m: F.abs(F.col("y_real") - F.col(m))
    values = [f"d{i}" for i in range(len(pairs))]
    rows = wide.select(*keys, time, *[(loss(a) - loss(b)).alias(v) for v, (a, b) in zip(values, pairs)])
    found = bootstrap_summary(rows, keys, time, values, resamples, block_lengths, seed)
    return unpivot(found, list(keys), [({"model_a": a, "model_b": b}, {
        "delta_mae": v, "low": f"{v}_low", "high": f"{v}_high", "excludes_zero": f"{v}_low > 0 OR {v}_high < 0",
        "block_days": "block_days"}) for v, (a, b) in zip(values, pairs)])


def bootstrap_differences(wide: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = (),
                          time: str = "target", resamples: int = 10_000, block_length: int = 7,
                          seed: int = 42) -> DataFrame:
    """:func:`block_sensitivity` for one block length."""
    return block_sensitivity(wide, pairs, keys, time, resamples, [block_length], seed).drop("block_days")
