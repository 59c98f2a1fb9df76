"""Ordered windows without one task per series.

A series is cut into blocks of positions.  Rows that a neighbouring block must
see (lags, rolling frames) are copied into it, and only the home copy is kept
after the window.  Every window over ``(keys, block)`` shares one exchange, and
one very long series, or one hot key, is still spread over many tasks.
Values that may come from arbitrarily far away (last known value, running
position) are carried by a second, much shorter window over the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


BLOCK = 4096


def block_of(pos: Column, size: int = BLOCK) -> Column:
    return F.floor(pos / F.lit(size))


def day_position(time: str) -> Column:
    """Position of a day on the calendar; equals row order on a gap-free series."""
    return F.unix_date(F.col(time)).cast("bigint")


def over_blocks(
    df: DataFrame,
    keys: Sequence[str],
    pos: Column,
    build: Callable[[WindowSpec], dict[str, Column]],
    back: int = 0,
    ahead: int = 0,
    size: int = BLOCK,
    then: Callable[[WindowSpec], dict[str, Column]] | None = None,
) -> DataFrame:
    """Add window columns that look at most ``back`` / ``ahead`` positions away.

    ``build`` receives the ordered window of a block and returns the new
    columns; ``then`` may add columns computed from those over the same window.
    Positions must be consecutive integers within a series.
    """
    low, high = block_of(pos - F.lit(ahead), size), block_of(pos + F.lit(back), size)
    spread = df.withColumn("_pos", pos)
    if back or ahead:
        spread = spread.withColumn("_block", F.explode(F.sequence(low, high)))
    else:
        spread = spread.withColumn("_block", low)
    window = Window.partitionBy(*keys, "_block").orderBy("_pos")
    out = spread.withColumns(build(window))
    if then:
        out = out.withColumns(then(window))
    return out.where(F.col("_block") == block_of(F.col("_pos"), size)).drop("_pos", "_block")


def join_keys(df: DataFrame, other: DataFrame, keys: Sequence[str], also: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Join on ``keys``, a null key being a key like any other, and on ``also``, which is never null."""
    renamed = other.withColumnsRenamed({c: f"_of_{c}" for c in [*keys, *also]})
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys] + [F.col(c) == F.col(f"_of_{c}") for c in also]
    return df.join(renamed, on, how).drop(*[f"_of_{c}" for c in [*keys, *also]])


KEY = "_key"


def pack_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys as one struct ``_key``, which is never null: an ordinary join on it keeps null keys, and windows and
    groupings by it share the join's exchange.  Without keys the table stays as it is."""
    return df.withColumn(KEY, F.struct(*keys)).drop(*keys) if keys else df


def unpack_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Undo :func:`pack_keys`."""
    return df.select(*[F.col(KEY)[k].alias(k) for k in keys], *[c for c in df.columns if c != KEY]) if keys else df


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Add per-series statistics; a global statistic is one row and becomes a scalar subquery."""
    if keys:
        return join_keys(df, stats, keys, how=how)
    packed = stats.select(F.struct(*[F.col(c) for c in stats.columns]).alias("s")).scalar()
    out = df.withColumn("_s", packed)
    return out.withColumns({c: F.col("_s")[c] for c in stats.columns}).drop("_s")


def attach_spread(df: DataFrame, stats: DataFrame, keys: Sequence[str], by: str, parts: int = 64) -> DataFrame:
    """:func:`attach` for tables whose groups have no size limit.

    Rows of a group are dealt to ``parts`` sub-groups by a hash of ``by``, and
    the one statistics row per group is repeated for each, so a hot group is
    joined by many tasks.  ``by`` should take many values within a group.
    """
    if not keys:
        return attach(df, stats, keys)
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    repeated = stats.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return join_keys(dealt, repeated, keys, ["_part"]).drop("_part")


def with_headers(
    df: DataFrame, keys: Sequence[str], order: str, headers: DataFrame,
    build: Callable[[WindowSpec], dict[str, Column]],
) -> DataFrame:
    """Window columns over ``(keys, _block)`` that also see one header row per block.

    ``headers`` (keys, ``_block``, facts about the block or its series) is put
    in front of the block's rows instead of being joined to them: the rows are
    shuffled once, for the window, and not a second time for a join.  ``build``
    reads a fact with :func:`fact`; a header has no ``order`` value, so it
    comes first in ascending and last in descending order.
    """
    together = df.withColumn("_header", F.lit(False)).unionByName(
        headers.withColumn("_header", F.lit(True)), allowMissingColumns=True)
    window = Window.partitionBy(*keys, "_block")
    out = together.withColumns(build(window.orderBy(F.asc_nulls_first(order))))
    extra = [c for c in headers.columns if c not in (*keys, "_block")]
    return out.where(~F.col("_header")).drop("_header", *extra)


def fact(name: str, window: WindowSpec) -> Column:
    """A fact from the header row, which is the first of its block."""
    return F.first(name).over(window.rowsBetween(Window.unboundedPreceding, 0))


def with_position(
    df: DataFrame, keys: Sequence[str], time: str, name: str = "pos", total: str | None = None,
    means: Sequence[str] = (), size: int = BLOCK,
) -> DataFrame:
    """Zero-based row number by day, closed up over missing days.

    Rows are numbered inside calendar blocks; the block offsets come from a
    table with one row per series and block.  That table also yields the
    series' row count (``total``) and the means ``_mean_<c>`` when asked.
    """
    cut = df.withColumn("_block", block_of(day_position(time), size))
    counts = cut.groupBy(*keys, "_block").agg(
        F.count(F.lit(1)).alias("_c"), *[F.sum(c).alias(f"_sum_{c}") for c in means])
    series = Window.partitionBy(*keys)
    before = series.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    headers = counts.select(
        *keys, "_block",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        F.sum("_c").over(series).alias("_total"),
        *[(F.sum(f"_sum_{c}").over(series) / F.sum("_c").over(series)).alias(f"_avg_{c}") for c in means],
    )

    def build(w: WindowSpec) -> dict[str, Column]:
        # The header takes row number one.
        return {name: fact("_before", w) + F.row_number().over(w) - 2} | (
            {total: fact("_total", w)} if total else {}) | {
            f"_mean_{c}": fact(f"_avg_{c}", w) for c in means}

    return with_headers(cut, keys, time, headers, build).drop("_block")


def nearest_known(
    df: DataFrame,
    keys: Sequence[str],
    pos: Column,
    cols: Sequence[str],
    forward: bool = True,
    size: int = BLOCK,
) -> DataFrame:
    """Add ``_prev_<c>`` (and ``_next_<c>``): struct(pos, value) of the nearest non-null row.

    The row itself counts.  Inside a block this is a window; across blocks the
    last and first known value of each block is carried over in its header.
    """
    cut = df.withColumn("_pos", pos).withColumn("_block", block_of(pos, size))

    def known(c: str) -> Column:
        return F.expr(f"CASE WHEN `{c}` IS NOT NULL THEN struct(_pos AS p, `{c}` AS v) END")

    def edge(c: str, extreme: str) -> Column:
        at = f"CASE WHEN `{c}` IS NOT NULL THEN _pos END"
        return F.expr(f"CASE WHEN count(`{c}`) > 0 THEN struct({extreme}({at}) AS p, {extreme}_by(`{c}`, {at}) AS v) END")

    summary = cut.groupBy(*keys, "_block").agg(*[
        agg for c in cols for agg in (edge(c, "min").alias(f"_first_{c}"), edge(c, "max").alias(f"_last_{c}"))])
    # Looking ahead is looking back in reversed order: a frame that ends at the
    # last row would be evaluated anew for every row.
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    headers = summary.select(
        *keys, "_block",
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_from_{c}") for c in cols],
        *([F.last(f"_first_{c}", ignorenulls=True).over(later).alias(f"_to_{c}") for c in cols]
          if forward else []),
    )
    onward = (Window.partitionBy(*keys, "_block").orderBy(F.desc_nulls_last("_pos"))
              .rowsBetween(Window.unboundedPreceding, 0))

    def build(w: WindowSpec) -> dict[str, Column]:
        up_to = w.rowsBetween(Window.unboundedPreceding, 0)
        new = {f"_prev_{c}": F.coalesce(F.last(known(c), ignorenulls=True).over(up_to), fact(f"_from_{c}", w))
               for c in cols}
        if forward:
            new |= {f"_next_{c}": F.coalesce(F.last(known(c), ignorenulls=True).over(onward), fact(f"_to_{c}", w))
                    for c in cols}
        return new

    return with_headers(cut, keys, "_pos", headers, build).drop("_block")


def previous_day(df: DataFrame, keys: Sequence[str], time: str, name: str, size: int = BLOCK) -> DataFrame:
    """The day of the row before, however far back it lies."""
    cut = df.withColumn("_block", block_of(day_position(time), size))
    ends = cut.groupBy(*keys, "_block").agg(F.max(time).alias("_end"))
    headers = ends.select(
        *keys, "_block",
        F.lag("_end").over(Window.partitionBy(*keys).orderBy("_block")).alias("_from"))
    return with_headers(cut, keys, time, headers, lambda w: {
        name: F.coalesce(F.lag(time).over(w), fact("_from", w))}).drop("_block")


__all__ = ["BLOCK", "attach", "attach_spread", "block_of", "day_position", "fact", "join_keys", "nearest_known",
           "over_blocks", "pack_keys", "previous_day", "unpack_keys", "with_headers", "with_position"]
