"""Trained forecasters: boosted trees (pooled over the panel) and a linear model per series."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from daygrid.operators.blocks import attach
from daygrid.operators.evaluate import forecast_metrics
from daygrid.operators.forecast import persistence, prediction_rows
from daygrid.operators.learning import common_folds, direct_task, feature_groups, multi_horizon_task, require_both_parts, standardize
from daygrid.stage import stage

# Parameters the search selected, and the searched grid.
SELECTED = {"n_estimators": 300, "learning_rate": 0.03, "max_depth": 4, "subsample": 0.8,
            "colsample_bytree": 0.8, "min_child_weight": 1, "gamma": 0.0}
FULL_GRID = {"n_estimators": (300, 500), "learning_rate": (0.03, 0.05, 0.1), "max_depth": (4, 6, 8),
             "subsample": (0.7, 0.8), "colsample_bytree": (0.7, 0.8), "min_child_weight": (1, 3),
             "gamma": (0.0, 0.1)}
# Boosting rounds between two checkpoints of the residuals: their lineage stays short, and few rounds wait for a write.
ROUNDS = 50
# Fits that run side by side: a boosting round is a row of short jobs, so several fill the executors one would leave idle.
TOGETHER = 8
# Horizons and windows of the direct protocol.
HORIZONS = (1, 3, 7, 14)


def regressor(params: Mapping[str, float], features: str = "features", label: str = "label", seed: int = 42) -> GBTRegressor:
    """Familiar boosting parameters on the MLlib learner (squared loss, first-order gain)."""
    p = SELECTED | dict(params)
    return GBTRegressor(
        featuresCol=features, labelCol=label, predictionCol="prediction", seed=seed,
        maxIter=int(p["n_estimators"]), stepSize=float(p["learning_rate"]), maxDepth=int(p["max_depth"]),
        subsamplingRate=float(p["subsample"]), featureSubsetStrategy=str(float(p["colsample_bytree"])),
        minInstancesPerNode=int(p["min_child_weight"]), minInfoGain=float(p["gamma"]), checkpointInterval=ROUNDS)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    cast = df.withColumns({c: F.col(c).cast("double") for c in df.columns if c == "label" or c.startswith("label_")})
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(cast)


def stored(df: DataFrame) -> DataFrame:
    """Written in as few partitions as its bytes justify: every boosting round runs a task per partition."""
    return stage(df.hint("rebalance"))


def side_by_side(work: Callable, cases: Sequence, together: int = TOGETHER) -> list:
    """``work`` on every case, ``together`` at a time, results in order; each is a series of Spark jobs."""
    with ThreadPool(max(1, min(together, len(cases)))) as pool:
        return pool.map(work, cases, chunksize=1)


def boosted_trees(task: DataFrame, keys: Sequence[str], features: Sequence[str], horizon: int,
                  params: Mapping[str, float] | None = None, name: str = "boosted_trees",
                  ) -> tuple[DataFrame, GBTRegressionModel]:
    """Fit on the ``train`` rows of a direct task, predict the ``test`` rows."""
    table = stored(assemble(task, features).select(*keys, "origin", "target", "label", "split", "features"))
    require_both_parts(table)
    model = regressor(params or {}).fit(table.where("split = 'train'").select("features", "label"))
    scored = model.transform(table.where("split = 'test'"))
    return prediction_rows(scored, keys, name, horizon, "label", "prediction"), model


def boosted_trees_by_horizon(task: DataFrame, keys: Sequence[str], features: Sequence[str], horizons: Sequence[int],
                             params: Mapping[str, float] | None = None, name: str = "boosted_trees",
                             together: int = TOGETHER) -> tuple[DataFrame, dict[int, GBTRegressionModel]]:
    """An independent model per horizon of a multi-horizon task, fitted side by side on one assembled table."""
    labels = [c for h in horizons for c in (f"label_{h}", f"split_{h}")]
    table = stored(assemble(task, features).select(*keys, "origin", *labels, "features"))
    for h in horizons:
        require_both_parts(table, f"split_{h}")

    def fit(h: int) -> GBTRegressionModel:
        train = table.where(F.col(f"split_{h}") == "train").select("features", F.col(f"label_{h}").alias("label"))
        return regressor(params or {}).fit(train)

    models = dict(zip(horizons, side_by_side(fit, list(horizons), together)))
    out = None
    for h, model in models.items():
        test = table.where(F.col(f"split_{h}") == "test").withColumn("target", F.date_add("origin", h))
        part = prediction_rows(model.transform(test), keys, name, h, f"label_{h}", "prediction")
        out = part if out is None else out.unionByName(part)
    return out, models


def grid_points(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def grid_search(task: DataFrame, keys: Sequence[str], features: Sequence[str], grid: Mapping[str, Sequence],
                n_splits: int = 5, together: int = TOGETHER) -> tuple[DataFrame, dict]:
    """Mean absolute error of every grid point over expanding folds, and the best point.

    The model is pooled over series, so folds are cut on common target dates:
    no series is trained on days that another is tested on.  Points that differ in
    the number of trees alone are one fit: the first trees of a long model are the short
    model, and one pass over the test rows gives the error after every tree.  The fits
    run ``together`` at a time.  Only one number per (point, fold) reaches the driver.
    """
    rows = assemble(task.where("split = 'train'"), features).select(*keys, "target", "label", "features")
    folds = stage(rows.join(common_folds(rows, "target", n_splits), "target").hint("rebalance", F.col("fold")), "fold")
    names, counts = list(grid), sorted({int(n) for n in grid.get("n_estimators", (SELECTED["n_estimators"],))})
    longest = [dict(p, n_estimators=counts[-1]) for p in grid_points({n: v for n, v in grid.items() if n != "n_estimators"})]

    def score(case: tuple[dict, int]) -> list[tuple]:
        point, fold = case
        part = folds.where(F.col("fold") == fold)
        model = regressor(point).fit(part.where("role = 'train'").select("features", "label"))
        errors = model.evaluateEachIteration(part.where("role = 'test'").select("features", "label"), "absolute")
        return [(*[float((point | {"n_estimators": n})[c]) for c in names], fold, float(errors[n - 1])) for n in counts]

    cases = [(p, k) for p in longest for k in range(n_splits)]
    results = [row for rows in side_by_side(score, cases, together) for row in rows]
    schema = ", ".join([f"{n} double" for n in names] + ["fold int", "mae double"])
    table = task.sparkSession.createDataFrame(results, schema)
    means = table.groupBy(*names).agg(F.avg("mae").alias("mae"), F.stddev_pop("mae").alias("mae_std"))
    best = means.orderBy("mae", *names).first()
    return means, {n: best[n] for n in names}


def search_and_refit(task: DataFrame, keys: Sequence[str], features: Sequence[str], horizon: int, grid: Mapping[str, Sequence],
                     n_splits: int = 5, name: str = "boosted_trees") -> tuple[DataFrame, DataFrame, GBTRegressionModel]:
    """Search the grid, fit the best point on all training rows, predict the test rows: (scores, predictions, model)."""
    means, best = grid_search(task, keys, features, grid, n_splits)
    preds, model = boosted_trees(task, keys, features, horizon, best, name)
    return means, preds, model


def feature_importance(model: GBTRegressionModel, features: Sequence[str], spark, top: int = 15) -> DataFrame:
    """Normalised gain per feature, strongest first."""
    weights = [(f, float(w)) for f, w in zip(features, model.featureImportances.toArray())]
    return (spark.createDataFrame(weights, "feature string, importance double")
            .orderBy(F.col("importance").desc(), "feature").limit(top))


# --- linear model per series -----------------------------------------------------------


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(cross: pd.Series, moment: pd.Series) -> pd.Series:
    """Least-squares coefficients from the packed normal equations of each series."""
    def one(a, b):
        size = len(b)
        matrix = np.zeros((size, size))
        matrix[np.triu_indices(size)] = a
        matrix = matrix + np.triu(matrix, 1).T
        return np.linalg.lstsq(matrix, np.asarray(b, dtype=float), rcond=None)[0].tolist()
    return pd.Series([one(a, b) for a, b in zip(cross, moment)])


def direct_arx(task: DataFrame, keys: Sequence[str], features: Sequence[str], horizon: int, name: str = "arx") -> DataFrame:
    """One linear model per series on covariates known at the origin, standardised on its training rows.

    The normal equations are sums, so any number of rows and series is one
    aggregation; only the small systems (one per series) are solved in Python.
    Rows with a missing covariate are left out of training and testing alike, and
    a series without a training row gets null predictions.
    """
    doubles = task.withColumns({f: F.col(f).cast("double") for f in features}).dropna(subset=list(features))
    scaled = standardize(doubles.withColumn("label", F.col("label").cast("double")), keys, features)
    design = [F.lit(1.0), *[F.col(f) for f in features]]
    cross = [F.sum(design[i] * design[j]) for i in range(len(design)) for j in range(i, len(design))]
    moment = [F.sum(d * F.col("label")) for d in design]
    sums = scaled.where("split = 'train'").groupBy(*keys).agg(
        F.array(*cross).alias("_a"), F.array(*moment).alias("_b"))
    weights = sums.select(*keys, _solve("_a", "_b").alias("_w"))
    scored = attach(scaled.where("split = 'test'"), weights, keys, how="left")
    total = sum((d * F.col("_w")[i] for i, d in enumerate(design)), F.lit(0.0))
    return prediction_rows(scored.withColumn("_pred", total), keys, name, horizon, "label", "_pred")


# --- experiments ------------------------------------------------------------------------


def direct_forecast(panel: DataFrame, keys: Sequence[str], time: str, value: str, features: Sequence[str],
                    test: tuple, train: tuple | None = None, models: Iterable[str] = ("boosted_trees",),
                    horizons: Iterable[int] = HORIZONS, params: Mapping[str, float] | None = None,
                    arx_features: Sequence[str] | None = None) -> DataFrame:
    """An independent model per horizon, all scored on the same target dates."""
    horizons, (start, end) = list(horizons), train or (None, None)
    parts = []
    for model in models:
        if model == "boosted_trees":
            task = multi_horizon_task(panel, keys, time, value, horizons, *test, start, end)
            parts.append(boosted_trees_by_horizon(task, keys, features, horizons, params)[0])
        elif model == "arx":
            parts += [direct_arx(direct_task(panel, keys, time, value, h, *test, start, end), keys, arx_features or features, h)
                      for h in horizons]
        elif model == "persistence":
            parts += [persistence(panel, keys, time, value, h, *test) for h in horizons]
        else:
            raise ValueError(f"unknown model {model!r}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# The planned feature subsets of the ablation.
ABLATION = {
    "full": ("history", "calendar", "weather"),
    "history+calendar": ("history", "calendar"),
    "weather+calendar": ("weather", "calendar"),
    "history": ("history",),
    "calendar": ("calendar",),
}


def ablation(panel: DataFrame, keys: Sequence[str], time: str, value: str, features: Sequence[str],
             calendar: Sequence[str], test: tuple, params: Mapping[str, float] | None = None,
             horizon: int = 1) -> tuple[DataFrame, DataFrame]:
    """Same parameters, fewer features; plus the persistence row.  Returns predictions and metrics."""
    own = lambda c: c == value or c.startswith(f"{value}_lag_")
    groups = feature_groups(features, {"history": own, "calendar": lambda c: c in calendar,
                                       "weather": lambda c: not own(c) and c not in calendar})
    task = direct_task(panel, keys, time, value, horizon, *test)
    table = stored(assemble(task, features).select(*keys, "origin", "target", "label", "split", "features"))
    require_both_parts(table)
    names = {variant: [f for p in parts for f in groups[p]] for variant, parts in ABLATION.items()}
    sizes = {variant: len(own) for variant, own in names.items()}
    sliced = {variant: VectorSlicer(inputCol="features", outputCol="subset", names=own).transform(table) for variant, own in names.items()}
    fit = lambda variant: regressor(params or {}, features="subset").fit(
        sliced[variant].where("split = 'train'").select("subset", "label"))
    out = None
    for variant, model in zip(names, side_by_side(fit, list(names))):
        part = prediction_rows(model.transform(sliced[variant].where("split = 'test'")), keys, variant, horizon,
                               "label", "prediction")
        out = part if out is None else out.unionByName(part)
    sizes["persistence"] = 1
    out = out.unionByName(persistence(panel, keys, time, value, horizon, *test))
    size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    metrics = forecast_metrics(out, [*keys, "model"]).withColumn("n_features", size[F.col("model")].cast("bigint"))
    return out, metrics


__all__ = ["ABLATION", "FULL_GRID", "HORIZONS", "SELECTED", "ablation", "assemble", "boosted_trees",
           "boosted_trees_by_horizon", "direct_arx", "direct_forecast", "feature_importance", "grid_points",
           "grid_search", "regressor", "side_by_side"]
