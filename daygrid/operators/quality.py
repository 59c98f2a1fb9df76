"""Rules that return their violations; an empty result means the rule holds."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, functions as F

from daygrid.functions.columns import SENTINEL_LIMIT, all_of, any_of
from daygrid.operators.blocks import KEY, join_keys, pack_keys, previous_day, unpack_keys
from daygrid.stage import stage


class QualityError(ValueError):
    """A required rule is broken."""


def require(violations: DataFrame, message: str, examples: int = 5) -> None:
    """Raise with a few example rows when ``violations`` is not empty."""
    rows = violations.take(examples)
    if rows:
        raise QualityError(f"{message}; examples={[tuple(r) for r in rows]}")


class Guard:
    """Rules that the write of a result checks by the way, without a pass of their own.

    :meth:`watch` adds counters of the violations to a step of the plan; :meth:`stage`
    writes a result that was built on the watched steps, and raises when a rule
    was broken.  A guard belongs to one write.
    """

    def __init__(self) -> None:
        self._watched: list[tuple[Observation, list[str], str | None]] = []

    def watch(self, df: DataFrame, rules: dict[str, Column], shown: Sequence[str], empty: str | None = None) -> DataFrame:
        """``rules`` name what is wrong where a condition holds; ``shown`` columns make the example, ``empty`` refuses a table without rows."""
        seen = Observation()
        example = F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})
        counters = [c for i, broken in enumerate(rules.values()) for c in (
            F.count_if(broken).alias(f"n{i}"), F.min(F.when(broken, example)).alias(f"example{i}"))]
        self._watched.append((seen, list(rules), empty))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *counters)

    def stage(self, df: DataFrame) -> DataFrame:
        stored = stage(df)
        for seen, messages, empty in self._watched:
            try:
                found = seen.get
            except Py4JJavaError:
                # Of a table the optimizer knows to be empty nothing runs, and the counters have no values.
                if not stored.isEmpty():
                    raise
                found = {"rows": 0}
            if not found["rows"]:
                if empty:
                    raise QualityError(empty)
                continue
            for i, message in enumerate(messages):
                if found[f"n{i}"]:
                    raise QualityError(f"{message}; rows={found[f'n{i}']}, example={found[f'example{i}']}")
        return stored


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise QualityError(f"missing required columns: {missing}")
    return df


def require_non_empty(df: DataFrame, message: str = "empty dataset") -> DataFrame:
    if df.isEmpty():
        raise QualityError(message)
    return df


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [n for n, t in df.dtypes if t in kinds or t.startswith("decimal")]


def duplicate_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    require_columns(df, cols)
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def invalid_keys(df: DataFrame, cols: Sequence[str], timestamps: Sequence[str] = ()) -> DataFrame:
    """Rows with a null key or a timestamp text that does not parse."""
    parsed = [F.try_to_timestamp(F.col(c)).isNull() if dict(df.dtypes)[c] == "string"
              else F.col(c).isNull() for c in timestamps]
    return df.where(any_of([F.col(c).isNull() for c in cols] + parsed))


def conflicting_duplicates(df: DataFrame, cols: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys whose copies differ in some value; a null counts as a value of its own.

    Identical copies collapse on the map side first, so a key with very many
    of them sends one row per task; then the versions per key are counted.
    """
    versions = df.groupBy(*cols, *values).agg(F.count(F.lit(1)).alias("_copies"))
    return (versions.groupBy(*cols)
            .agg(F.count(F.lit(1)).alias("_versions"), F.sum("_copies").alias("copies"))
            .where("_versions > 1").select(*cols, "copies"))


def collapse_identical(df: DataFrame, cols: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key once :func:`conflicting_duplicates` is empty."""
    return df.select(*cols, *values).distinct()


def collapse_versions(df: DataFrame, cols: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key and ``_conflict``: whether its copies differ, a null being a value of its own.

    Smallest, largest and number of known values combine on the map side, so a
    key is shuffled as one row per task, once for the check and the result.
    """
    seen = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"), *[c for i, v in enumerate(values) for c in (
        F.min(v).alias(f"_low{i}"), F.max(v).alias(f"_high{i}"), F.count(v).alias(f"_known{i}"))])
    differ = [c for i in range(len(values)) for c in (
        F.coalesce(F.col(f"_low{i}") != F.col(f"_high{i}"), F.lit(False)),
        (F.col(f"_known{i}") > 0) & (F.col(f"_known{i}") < F.col("_copies")))]
    return seen.select(*cols, *[F.col(f"_low{i}").alias(v) for i, v in enumerate(values)], any_of(differ).alias("_conflict"))


def drop_conflicts(df: DataFrame, cols: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys whose copies agree, collapsed to one row; keys with conflicts are left out."""
    versions = df.select(*cols, *values).distinct()
    row = F.struct(*[F.col(v) for v in values])
    one = versions.groupBy(*cols).agg(F.count(F.lit(1)).alias("_versions"), F.any_value(row).alias("_row"))
    return one.where("_versions = 1").select(*cols, "_row.*")


def dedup_events(df: DataFrame, ids: Sequence[str], ts: str, payload: Sequence[str] = ()) -> DataFrame:
    """One row per event: the earliest start, ties broken by the smallest payload.

    Spark has no file order, so "first occurrence" means earliest start.  The
    group aggregate combines copies on the map side, which a window would not.
    """
    if not payload:
        return df.groupBy(*ids).agg(F.min(ts).alias(ts))
    first = F.min(F.struct(ts, *payload)).alias("_row")
    return df.groupBy(*ids).agg(first).select(*ids, "_row.*")


def date_gaps(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Consecutive rows of a series that are more than one day apart."""
    gap = F.datediff(F.col(time), F.col("previous"))
    return (previous_day(df.select(*keys, time), keys, time, "previous")
            .where(gap > 1)
            .select(*keys, "previous", time, (gap - 1).cast("bigint").alias("missing_days")))


def null_counts(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Missing values per column in one pass; NaN is missing too."""
    floating = {n for n, t in df.dtypes if t in ("double", "float")}
    missing = [
        F.count_if(F.col(c).isNull() | F.isnan(c) if c in floating else F.col(c).isNull()).alias(c)
        for c in cols]
    wide = df.groupBy(*keys).agg(*missing)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols])
    return wide.select(*keys, F.inline(pairs))


def apply_domain_rules(
    df: DataFrame, measures: Sequence[str], non_negative: Sequence[str] = (),
    ranges: dict[str, tuple[float, float]] | None = None, sentinel: float = SENTINEL_LIMIT,
) -> DataFrame:
    """Turn impossible readings into null; there are no upper caps besides ``ranges``."""
    ranges = ranges or {}

    def clean(name: str) -> Column:
        c = F.col(name)
        rules = [c > sentinel]
        if name in non_negative:
            rules.append(c >= 0)
        if name in ranges:
            rules.append(c.between(*ranges[name]))
        return F.when(all_of(rules), c)

    return df.withColumns({m: clean(m) for m in measures})


def read_sentinel(df: DataFrame, measures: Sequence[str], code: float = -9999.0) -> DataFrame:
    """One exact code means missing."""
    return df.withColumns({m: F.nullif(F.col(m), F.lit(code)) for m in measures})


def integer_target(df: DataFrame, value: str) -> DataFrame:
    """Rows whose target is not a whole number (absolute 1e-8 plus relative 1e-5)."""
    c = F.col(value).cast("double")
    nearest = F.rint(c)
    return df.where(c.isNull() | ~(F.abs(c - nearest) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(nearest)))


def as_integer_target(df: DataFrame, value: str) -> DataFrame:
    require(integer_target(df, value), f"{value} must hold whole counts")
    return df.withColumn(value, F.rint(F.col(value).cast("double")).cast("bigint"))


def numeric_target(df: DataFrame, value: str) -> DataFrame:
    """Rows whose target is missing or not a number."""
    as_number = F.expr(f"try_cast(`{value}` AS double)")
    return df.where(as_number.isNull() | F.isnan(as_number))


def require_one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> None:
    require(duplicate_keys(left, on), "left side repeats join keys")
    require(duplicate_keys(right, on), "right side repeats join keys")


# --- rules on long prediction tables -------------------------------------------------


def same_dates_across_models(preds: DataFrame, models: Sequence[str], by: Sequence[str] = ("horizon",),
                             model: str = "model", target: str = "target") -> DataFrame:
    """Dates that some model of the list does not predict."""
    return (preds.where(F.col(model).isin(list(models)))
            .groupBy(*by, target)
            .agg(*[F.max((F.col(model) == m).cast("int")).alias(f"_m{i}") for i, m in enumerate(models)])
            .select(*by, target, sum((F.col(f"_m{i}") for i in range(len(models))), F.lit(0))
                    .cast("bigint").alias("models"))
            .where(F.col("models") != len(models)))


def prediction_coverage(
    preds: DataFrame, models: Sequence[str], horizons: Sequence[int], start, end, cutoff,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Expected (model, horizon) pairs against what is there, one row per pair and series.

    ``ok`` needs n, first and last target date, target - origin = horizon and
    no origin before the day ahead of the training cutoff.
    """
    series = preds.select(*keys).distinct() if keys else preds.sparkSession.range(1).select()
    grid = series.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(int(h)).alias("horizon")) for m in models for h in horizons])))
    seen = preds.groupBy(*keys, "model", F.col("horizon").cast("int").alias("horizon")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("target").alias("_days"),
        F.min("target").alias("first_target"), F.max("target").alias("last_target"),
        F.min("origin").alias("first_origin"),
        F.count_if(F.datediff("target", "origin") != F.col("horizon")).alias("wrong_delta"))
    lo, hi = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    days = F.datediff(hi, lo) + 1
    grid = grid.withColumn("expected", F.lit(True))
    ok = ((F.col("n") == days) & (F.col("_days") == days) & (F.col("first_target") == lo)
          & (F.col("last_target") == hi) & (F.col("wrong_delta") == 0)
          & (F.col("first_origin") >= F.date_sub(F.lit(str(cutoff)).cast("date"), 1))
          & F.col("expected"))
    on = [*([KEY] if keys else []), "model", "horizon"]
    return (unpack_keys(pack_keys(seen, keys).join(pack_keys(grid, keys), on, "full_outer"), keys)
            .select(*keys, "model", "horizon",
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
                    "first_target", "last_target", "first_origin",
                    F.coalesce("wrong_delta", F.lit(0)).cast("bigint").alias("wrong_delta"),
                    F.coalesce("expected", F.lit(False)).alias("expected"),
                    F.coalesce(ok, F.lit(False)).alias("ok")))


def require_complete_results(preds: DataFrame, models: Sequence[str], horizons: Sequence[int], start, end,
                             keys: Sequence[str] = ()) -> None:
    """Long predictions hold every (model, horizon) of the lists on every day from ``start`` to ``end``, and no other row."""
    values = ["model", "horizon", "origin", "target", "y_real", "y_pred"]
    require_columns(preds, [*keys, *values])
    require(preds.where(any_of([F.col(c).isNull() for c in values])), "predictions with missing values")
    require(duplicate_keys(preds, [*keys, "model", "horizon", "target"]), "a model predicts a date twice")
    first = F.lit(str(start)).cast("date")
    wrong = preds.where(~F.col("target").between(first, F.lit(str(end)).cast("date")))
    require(wrong, "predictions outside the test period")
    cutoff = date.fromisoformat(str(start)) - timedelta(days=max(horizons, default=1) - 1)  # origins follow from the horizons
    require(prediction_coverage(preds, models, horizons, start, end, cutoff, keys).where(~F.col("ok")),
            "predictions missing, of a wrong date or of a pair that is not expected")


def same_actuals_across_models(preds: DataFrame, by: Sequence[str] = ("horizon",), tolerance: float = 1e-3) -> DataFrame:
    """Target dates on which the models were scored against different truths."""
    spread = F.max("y_real") - F.min("y_real")
    return (preds.groupBy(*by, "target").agg(spread.alias("spread"))
            .where(~(F.col("spread") < tolerance)))


def common_dates(preds: DataFrame, models: Sequence[str], expected: int, by: Sequence[str] = ("horizon",)) -> DataFrame:
    """Groups whose number of dates shared by all models is not ``expected``."""
    shared = (preds.where(F.col("model").isin(list(models)))
              .groupBy(*by, "target").agg(F.count_distinct("model").alias("m")))
    return (shared.groupBy(*by)
            .agg(F.count_if(F.col("m") == len(models)).alias("dates"))
            .where(F.col("dates") != expected))


def target_covers_predictions(preds: DataFrame, target: DataFrame, keys: Sequence[str] = (), time: str = "day") -> DataFrame:
    """Predicted dates without a canonical target."""
    have = target.select(*keys, F.col(time).alias("target"))
    return join_keys(preds.select(*keys, "target").distinct(), have, keys, ["target"], "left_anti")


def no_leakage(train: DataFrame, test: DataFrame, keys: Sequence[str] = (), by: Sequence[str] = ("horizon",)) -> DataFrame:
    """Groups whose latest training target lies after the first test origin, and groups with one part only."""
    cols = [*keys, *by]
    last = train.groupBy(*cols).agg(F.max("target").alias("last_train_target"))
    first = test.groupBy(*cols).agg(F.min("origin").alias("first_test_origin"))
    both = unpack_keys(pack_keys(last, cols).join(pack_keys(first, cols), KEY, "full"), cols)
    leaks = F.col("last_train_target") > F.col("first_test_origin")
    return both.where(F.coalesce(leaks, F.lit(True)))


def fitted_leakage(fitted: DataFrame, split: DataFrame, keys: Sequence[str] = (), time: str = "day") -> DataFrame:
    """Series whose statistics (``fitted``: first_day, last_day, rows) were not fitted on exactly the training rows of ``split``.

    A day on or after the first test day, another number of rows, a series without
    statistics and one without training rows are all reported.
    """
    is_train = F.col("split") == "train"
    parts = split.groupBy(*keys).agg(
        F.count_if(is_train).alias("train_rows"), F.min(F.when(is_train, F.col(time))).alias("train_first"),
        F.max(F.when(is_train, F.col(time))).alias("train_last"), F.min(F.when(F.col("split") == "test", F.col(time))).alias("test_first"))
    on = [KEY] if keys else []
    left, right = (pack_keys(df, keys) for df in (parts, fitted))
    both = unpack_keys(left.join(right, on, "full") if on else left.join(right, F.lit(True), "full"), keys)
    same = ((F.col("rows") == F.col("train_rows")) & (F.col("first_day") == F.col("train_first"))
            & (F.col("last_day") == F.col("train_last")) & (F.col("last_day") < F.coalesce("test_first", F.date_add("last_day", 1))))
    return both.where(~F.coalesce(same, F.lit(False)))


LEAST_TRAIN_DAYS, LEAST_TEST_DAYS = 180, 7  # fixed values


def experiment_violations(models, horizons, train, test, known_models, known_horizons=(1, 3, 7, 14)) -> list[str]:
    """Every argument rule an experiment breaks; rules that need no data."""
    days = lambda period: (period[1] - period[0]).days + 1
    longest, apart = max(horizons, default=0), (test[0] - train[1]).days
    table = {
        "no model": not models, "no horizon": not horizons,
        "model not known": not set(models) <= set(known_models),
        "horizon not known": not set(horizons) <= set(known_horizons),
        f"fewer than {LEAST_TRAIN_DAYS} training days": days(train) < LEAST_TRAIN_DAYS,
        f"fewer than {LEAST_TEST_DAYS} evaluation days": days(test) < LEAST_TEST_DAYS,
        "evaluation begins before training ends": apart <= 0,
        f"evaluation begins within {longest} days of training": 0 < apart < longest,
    }
    return [rule for rule, broken in table.items() if broken]


def check_experiment(models, horizons, train, test, known_models, known_horizons=(1, 3, 7, 14)) -> None:
    """Raise with all violations of the argument rules."""
    if found := experiment_violations(models, horizons, train, test, known_models, known_horizons):
        raise QualityError("; ".join(found))


def experiment_bounds(df: DataFrame, keys: Sequence[str], time: str, value: str, train, test) -> DataFrame:
    """Series that cannot serve the experiment: out of range, too short or too late."""
    (a, b), (c, d) = train, test
    usable = df.where(F.col(value).isNotNull())
    inside = lambda lo, hi: F.col(time).between(F.lit(str(lo)).cast("date"), F.lit(str(hi)).cast("date"))
    stats = usable.groupBy(*keys).agg(
        F.min(time).alias("first_day"), F.max(time).alias("last_day"),
        F.count_if(inside(a, b)).alias("train_days"), F.count_if(inside(c, d)).alias("test_days"))
    out_of_range = (F.col("first_day") > F.lit(str(a)).cast("date")) | (F.col("last_day") < F.lit(str(d)).cast("date"))
    return stats.where(out_of_range | (F.col("train_days") < 180) | (F.col("test_days") < 7))


def check_outputs(products: dict[str, DataFrame], required: Sequence[str]) -> None:
    """Every required product is present and holds rows."""
    missing = sorted(set(required) - set(products))
    empty = sorted(n for n in required if n in products and products[n].isEmpty())
    if missing or empty:
        raise QualityError(f"missing products: {missing}; empty products: {empty}")


