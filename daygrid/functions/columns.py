"""Column expressions shared by the operators.  All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Below this length a mean direction vector has no direction.
NO_DIRECTION = 1e-12
# Readings at or below this are a station's "missing" code.
SENTINEL_LIMIT = -999.0
# Band names and cut points for daily volume, in display order.
VOLUME_BANDS = ("Baixo volume (<200)", "Volume intermediário (200–400)", "Alto volume (>400)")
VOLUME_CUTS = (200, 400)


def column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def nan_to_null(value: str | Column) -> Column:
    """NaN means "missing" in the sources; Spark would let it poison every aggregate."""
    c = column(value)
    return F.when(~F.isnan(c), c)


def scan_clean(df: DataFrame) -> DataFrame:
    """Apply :func:`nan_to_null` to every floating column of a scan."""
    floating = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(*[nan_to_null(c).alias(c) if c in floating else F.col(c) for c in df.columns])


def floor_to_day(ts: str | Column) -> Column:
    return F.to_date(column(ts))


def month_date(year: str | Column, month: str | Column) -> Column:
    return F.make_date(column(year).cast("int"), column(month).cast("int"), F.lit(1))


def week_ending(day: str | Column, weekday: str) -> Column:
    """Label of the seven-day bin that ends on ``weekday`` (``MO``, ``SU``, ...)."""
    return F.next_day(F.date_sub(column(day), 1), weekday)


def bin_label(day: str | Column, freq: str) -> Column:
    if freq == "month":
        return F.trunc(column(day), "MM")
    if freq.startswith("week_"):
        return week_ending(day, {"mon": "MO", "sun": "SU"}[freq[5:]])
    if freq == "day":
        return column(day)
    raise ValueError(f"unknown frequency {freq!r}")


def bin_step(freq: str) -> Column:
    return F.expr({"month": "interval 1 month", "day": "interval 1 day"}.get(freq, "interval 7 days"))


def unit_sin(degrees: str | Column) -> Column:
    return F.sin(F.radians(F.pmod(column(degrees), F.lit(360.0))))


def unit_cos(degrees: str | Column) -> Column:
    return F.cos(F.radians(F.pmod(column(degrees), F.lit(360.0))))


def unit_vector(sin: Column, cos: Column) -> tuple[Column, Column]:
    """Scale (sin, cos) to length one; both null when the vector has no direction."""
    norm = F.hypot(sin, cos)
    ok = norm >= F.lit(NO_DIRECTION)
    return F.when(ok, sin / norm), F.when(ok, cos / norm)


def angle(sin: Column, cos: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(sin, cos)), F.lit(360.0))


def clip_non_negative(value: str | Column) -> Column:
    c = column(value)
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), c))


def unit_scale(value: str | Column, divisor: float = 1e6) -> Column:
    return column(value) / F.lit(float(divisor))


def between_days(day: str | Column, start, end) -> Column:
    """Closed interval on dates."""
    return (column(day) >= F.lit(start).cast("date")) & (column(day) <= F.lit(end).cast("date"))


def within_period(ts: str | Column, start, end) -> Column:
    """Whole days from ``start`` to ``end`` on timestamps: half open at the day after ``end``."""
    low = F.lit(str(start)).cast("timestamp_ntz")
    high = F.lit(str(end)).cast("timestamp_ntz") + F.expr("interval 1 day")
    return (column(ts) >= low) & (column(ts) < high)


def band(value: str | Column, cuts=VOLUME_CUTS, labels=VOLUME_BANDS) -> Column:
    """Below the first cut, between the cuts (both inclusive), above the last."""
    c, (low, high) = column(value), cuts
    return F.when(c < low, labels[0]).when(c <= high, labels[1]).when(c > high, labels[2])


def band_order(value: str | Column, cuts=VOLUME_CUTS) -> Column:
    c, (low, high) = column(value), cuts
    return F.when(c < low, 0).when(c <= high, 1).when(c > high, 2)


def try_pearson(y: str, x: str) -> Column:
    """Pairwise-complete Pearson aggregate, null (never an error) for a constant column."""
    pair = f"(`{y}`, `{x}`)"
    return F.expr(f"try_divide(regr_sxy{pair}, sqrt(regr_sxx{pair} * regr_syy{pair}))")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def sql_literal(value) -> str:
    """A label or number as SQL text."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def unpivot(df: DataFrame, keys: list[str], rows: list[tuple[dict, dict]]) -> DataFrame:
    """One output row per entry: literal labels (first dict), then SQL expressions (second dict)."""
    entries = ", ".join("struct(" + ", ".join(
        [f"{sql_literal(v)} AS `{k}`" for k, v in labels.items()]
        + [f"{c} AS `{k}`" for k, c in values.items()]) + ")" for labels, values in rows)
    return df.select(*keys, F.expr(f"inline(array({entries}))"))
