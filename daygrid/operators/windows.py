"""Time-series operators on gap-free daily panels.

Run :func:`daygrid.operators.calendar.complete_calendar` (or reindex) first:
frames count rows, and rows are days only when no day is missing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from daygrid.functions.columns import NO_DIRECTION
from daygrid.operators.blocks import BLOCK, attach, day_position, join_keys, nearest_known, over_blocks
from daygrid.operators.ranks import quantiles


def lag_columns(w: WindowSpec, cols: Sequence[str], steps: Sequence[int]) -> dict[str, Column]:
    return {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in cols for k in steps}


def rolling_std_columns(w: WindowSpec, cols: Sequence[str], window: int) -> dict[str, Column]:
    frame = w.rowsBetween(-(window - 1), 0)
    return {f"{c}_std_{window}d": F.when(F.count(c).over(frame) == window, F.stddev_samp(c).over(frame))
            for c in cols}


def rolling_mean_columns(w: WindowSpec, cols: Sequence[str], windows: Sequence[int]) -> dict[str, Column]:
    return {f"{c}_mean_{n}d": F.avg(c).over(w.rowsBetween(-(n - 1), 0)) for c in cols for n in windows}


def lags(df, keys, time, cols, steps, size: int = BLOCK) -> DataFrame:
    return over_blocks(df, keys, day_position(time), lambda w: lag_columns(w, cols, steps),
                       back=max(steps), size=size)


def rolling_mean(df, keys, time, cols, windows, size: int = BLOCK) -> DataFrame:
    """Mean of the last n rows, already from the first row on."""
    return over_blocks(df, keys, day_position(time), lambda w: rolling_mean_columns(w, cols, windows),
                       back=max(windows) - 1, size=size)


def rolling_std(df, keys, time, cols, window: int = 7, size: int = BLOCK) -> DataFrame:
    """Sample deviation of the last ``window`` rows, null until there are that many values."""
    return over_blocks(df, keys, day_position(time), lambda w: rolling_std_columns(w, cols, window),
                       back=window - 1, size=size)


# --- exponential moving average -------------------------------------------------------


def ema_reach(spans: Sequence[int]) -> int:
    """Days after which the slowest average has forgotten all but 1e-20 of a value."""
    slowest = max(_keep(s) for s in spans)
    fastest = min(_keep(s) for s in spans if s > 1) if any(s > 1 for s in spans) else 0.5
    if slowest == 0.0:
        return 1
    reach = math.ceil(46.1 / -math.log(slowest))
    if reach * -math.log(fastest) > 600:
        raise ValueError("spans are too far apart for one pass; compute them in separate calls")
    return reach


def _keep(span: int) -> float:
    if span < 1:
        raise ValueError("span must be at least 1")
    return 1.0 - 2.0 / (span + 1.0)


def ema_columns(keys: Sequence[str], cols: Sequence[str], spans: Sequence[int], reach: int,
                block: str = "_block") -> tuple[dict[str, Column], dict[str, Column], list[str]]:
    """Exponential averages as two rounds of windows that share the block's exchange.

    A short run of ``reach`` days is summed with weights ``q^-offset`` (which
    cannot overflow over so few days); the end of the run before is carried in.
    Whatever is older than two runs weighs less than 1e-20.
    Returns the first round, the second round and the helper columns to drop.
    """
    run = F.floor(F.col("_pos") / F.lit(reach))
    offset = F.pmod(F.col("_pos"), F.lit(reach))
    visible = Window.partitionBy(*keys, block).orderBy("_pos")
    inside = Window.partitionBy(*keys, block, run).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = visible.rowsBetween(Window.unboundedPreceding, -1)
    is_first = F.row_number().over(visible) == 1
    last_of_run = offset == reach - 1
    first, second, helpers = {"_first": is_first}, {}, ["_first"]
    for c in cols:
        for span in spans:
            name, q = f"{c}_ema_{span}", _keep(span)
            if q == 0.0:
                second[name] = F.col(c).cast("double")
                continue
            weight = F.when(F.col("_first"), F.lit(1.0)).otherwise(F.lit(1.0 - q))
            local = F.pow(F.lit(q), offset) * F.sum(weight * F.col(c) * F.pow(F.lit(q), -offset)).over(inside)
            helper = f"_local_{name}"
            helpers.append(helper)
            first[helper] = local
            end = F.last(F.when(last_of_run, F.col(helper)), ignorenulls=True).over(earlier)
            second[name] = F.col(helper) + F.pow(F.lit(q), offset + 1) * F.coalesce(end, F.lit(0.0))
    return first, second, helpers


def causal_columns(
    df: DataFrame, keys: Sequence[str], time: str, lag: tuple[Sequence[str], Sequence[int]] | None = None,
    ema: tuple[Sequence[str], Sequence[int]] | None = None, std: tuple[Sequence[str], int] | None = None,
    size: int = BLOCK,
) -> DataFrame:
    """Lags, exponential averages and rolling deviations behind one exchange."""
    back, first, second, helpers = 1, {}, {}, []
    if lag:
        back = max(back, max(lag[1]))
    if std:
        back = max(back, std[1] - 1)
    if ema:
        reach = ema_reach(ema[1])
        back = max(back, 2 * reach)
        first, second, helpers = ema_columns(keys, ema[0], ema[1], reach)

    pos = day_position(time)
    spread = df.withColumn("_pos", pos).withColumn(
        "_block", F.explode(F.sequence(F.floor(pos / F.lit(size)), F.floor((pos + back) / F.lit(size)))))
    w = Window.partitionBy(*keys, "_block").orderBy("_pos")
    if "_first" in first:
        spread = spread.withColumn("_first", first.pop("_first"))
    plain = {}
    if lag:
        plain |= lag_columns(w, *lag)
    if std:
        plain |= rolling_std_columns(w, *std)
    out = spread.withColumns(plain | first)
    if second:
        out = out.withColumns(second)
    home = F.col("_block") == F.floor(F.col("_pos") / F.lit(size))
    return out.where(home).drop("_pos", "_block", *helpers)


def ema(df, keys, time, cols, spans, size: int = BLOCK) -> DataFrame:
    """``y0 = x0``, ``y = a*x + (1-a)*y'`` with ``a = 2/(span+1)``; a null input is an error."""
    whole = {c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} has missing values; fill them first"))).otherwise(F.col(c))
             for c in cols}
    return causal_columns(df.withColumns(whole), keys, time, ema=(cols, spans), size=size)


# --- filling ----------------------------------------------------------------------------


def _fill(df, keys, pos, cols, tail: bool, head: bool, size: int) -> DataFrame:
    near = nearest_known(df, keys, pos, cols, size=size)

    def value(c: str) -> Column:
        before, after = f"`_prev_{c}`", f"`_next_{c}`"
        ends = (f"WHEN {before} IS NOT NULL THEN {before}.v " if tail else "") + \
            (f"WHEN {after} IS NOT NULL THEN {after}.v " if head else "")
        return F.expr(f"""CASE WHEN `{c}` IS NOT NULL THEN `{c}`
            WHEN {before} IS NOT NULL AND {after} IS NOT NULL
            THEN {before}.v + ({after}.v - {before}.v) / ({after}.p - {before}.p) * (_pos - {before}.p) {ends} END""")

    helpers = [f"_{side}_{c}" for c in cols for side in ("prev", "next")]
    filled = near.withColumns({c: value(c) for c in cols})
    return filled.drop("_pos", *helpers)


def interpolate_linear(df, keys, time, cols, size: int = BLOCK) -> DataFrame:
    """By row position; both ends take the nearest value.  For readings, never for the target."""
    return _fill(df, keys, day_position(time), cols, tail=True, head=True, size=size)


def interpolate_time(df, keys, time, cols, size: int = BLOCK) -> DataFrame:
    """Weighted by elapsed days, gaps allowed; the tail is filled, the head stays null."""
    return _fill(df, keys, day_position(time), cols, tail=True, head=False, size=size)


def causal_fill(df, keys, time, cols, size: int = BLOCK) -> DataFrame:
    """Last known value: imputation that uses only the past."""
    near = nearest_known(df, keys, day_position(time), cols, forward=False, size=size)
    return near.withColumns({c: F.col(f"_prev_{c}").v for c in cols}).drop(
        "_pos", *[f"_prev_{c}" for c in cols])


def renormalise_direction(df: DataFrame, sin: str = "dir_sin", cos: str = "dir_cos") -> DataFrame:
    norm = F.hypot(sin, cos)
    return df.withColumns({sin: F.col(sin) / norm, cos: F.col(cos) / norm}) if {sin, cos} <= set(df.columns) else df


def undefined_directions(df: DataFrame, sin: str = "dir_sin", cos: str = "dir_cos") -> DataFrame:
    """Rows whose direction vector cannot be scaled to length one."""
    return df.where(F.hypot(sin, cos) < F.lit(NO_DIRECTION))


def fill_with_train_median(df, keys, time, cols, cut) -> DataFrame:
    """Nulls become the median of the rows before ``cut``: nothing leaks from the test part."""
    train = df.where(F.col(time) < F.lit(str(cut)).cast("date"))
    out = df
    for c in cols:
        # One row per key and day, so the built-in exact median is bounded by the calendar.
        out = attach(out, quantiles(train, keys, c, {f"_median_{c}": 0.5}, small_groups=True), keys)
    return (out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_median_{c}")) for c in cols})
            .drop(*[f"_median_{c}" for c in cols]))


# --- decomposition, calendar, learning windows ---------------------------------------


def decompose_additive(df, keys, time, value, period: int = 365, size: int = BLOCK) -> DataFrame:
    """Classical decomposition: centred moving average, phase means, remainder.

    An even period uses half weights at both ends.  The trend is null within
    half a period of the ends.
    """
    half = period // 2

    def trend(w: WindowSpec) -> dict[str, Column]:
        # Differences of running sums, so that a long period costs no more than a short one.
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        sums = F.struct(F.sum("observed").over(so_far).alias("s"), F.count("observed").over(so_far).alias("n"))
        return {"_run": sums, "_edge": 0.5 * (F.lag("observed", half).over(w) + F.lead("observed", half).over(w))}

    def centred(w: WindowSpec) -> Column:
        last, before = F.lead("_run", half).over(w), F.lag("_run", half + 1).over(w)
        total = last.s - F.coalesce(before.s, F.lit(0.0))
        full = last.n - F.coalesce(before.n, F.lit(0)) == 2 * half + 1
        return F.when(full, (total - F.col("_edge") if period % 2 == 0 else total) / period)

    # Phases are counted on the calendar: another starting point only renames them.
    base = df.select(*keys, time, F.col(value).cast("double").alias("observed"),
                     F.pmod(day_position(time), F.lit(period)).alias("_phase"))
    with_trend = over_blocks(base, keys, day_position(time), trend, back=half + 1, ahead=half, size=size,
                             then=lambda w: {"trend": centred(w)}).drop("_run", "_edge")
    phases = with_trend.groupBy(*keys, "_phase").agg(F.avg(F.col("observed") - F.col("trend")).alias("_mean"))
    level = phases.groupBy(*keys).agg(F.avg("_mean").alias("_level"))
    seasonal = attach(phases, level, keys).select(
        *keys, "_phase", (F.col("_mean") - F.col("_level")).alias("seasonal"))
    # Without keys the phase table has at most ``period`` rows.
    if not keys:
        seasonal = F.broadcast(seasonal)
    return (join_keys(with_trend, seasonal, keys, ["_phase"], "left").drop("_phase")
            .withColumn("residual", F.col("observed") - F.col("trend") - F.col("seasonal"))
            .select(*keys, time, "observed", "trend", "seasonal", "residual"))


def calendar_columns(time: str) -> dict[str, Column]:
    month = F.month(time)
    return {
        "month": month.cast("bigint"),
        "weekday": F.weekday(time).cast("bigint"),
        "day_of_year": F.dayofyear(time).cast("bigint"),
        "month_sin": F.sin(F.lit(2 * math.pi) * month / 12),
        "month_cos": F.cos(F.lit(2 * math.pi) * month / 12),
    }


def calendar_features(df: DataFrame, time: str) -> DataFrame:
    """Month, weekday (Monday = 0), day of year and the month on a circle."""
    return df.withColumns(calendar_columns(time))


def lead_target(df, keys, time, value, horizon: int, size: int = BLOCK) -> DataFrame:
    """``label = y[t+h]`` and its date ``t+h``; rows whose target day is missing have none and are dropped.

    The label is looked up by date, not by row, so a gap cannot move it.
    """
    return (over_blocks(df, keys, day_position(time),
                        lambda w: {"label": F.first(value).over(w.rangeBetween(horizon, horizon))},
                        ahead=horizon, size=size)
            .where(F.col("label").isNotNull())
            .withColumn("target", F.date_add(time, horizon)))


def lead_targets(df, keys, time, value, horizons: Sequence[int], size: int = BLOCK) -> DataFrame:
    """``label_<h> = y[t+h]`` for every horizon, null where the target day is missing; all share one exchange."""
    return over_blocks(df, keys, day_position(time), lambda w: {
        f"label_{h}": F.first(value).over(w.rangeBetween(h, h)) for h in horizons}, ahead=max(horizons), size=size)


def sequence_windows(df, keys, time, features: Sequence[str], value, length: int = 14, horizon: int = 1,
                     size: int = BLOCK) -> DataFrame:
    """Windows of ``length`` rows ending at the origin, with the value ``horizon`` days on.

    ``horizon=1`` is also the variant "rows up to t-1 predict t".  Windows with
    a missing feature, day or target are not emitted.
    """
    row = F.array(*[F.col(f).cast("double") for f in features])
    whole = F.when(F.forall(row, lambda v: v.isNotNull()), row)

    def build(w: WindowSpec) -> dict[str, Column]:
        frame = w.rangeBetween(-(length - 1), 0)  # days, so a gap makes the window short
        return {"window": F.collect_list(whole).over(frame), "label": F.first(value).over(w.rangeBetween(horizon, horizon))}

    return (over_blocks(df.select(*keys, time, *dict.fromkeys([*features, value])), keys, day_position(time),
                        build, back=length - 1, ahead=horizon, size=size)
            .where((F.size("window") == length) & F.col("label").isNotNull())
            .select(*keys, F.col(time).alias("origin"), F.date_add(time, horizon).alias("target"),
                    "window", F.col("label").cast("double").alias("label")))


__all__ = [
    "calendar_features", "causal_columns", "causal_fill", "decompose_additive", "ema",
    "fill_with_train_median", "interpolate_linear", "interpolate_time", "lags", "lead_target", "lead_targets",
    "renormalise_direction", "rolling_mean", "rolling_std", "sequence_windows", "undefined_directions",
]
