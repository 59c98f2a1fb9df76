"""Writers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from daygrid.operators.blocks import join_keys
from daygrid.operators.quality import QualityError, require


def write_outputs(products: Mapping[str, DataFrame], folder: str, partition_by: Mapping[str, Sequence[str]] | None = None,
                  fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One table per product, parquet by default; ``partition_by`` names the layout columns."""
    for name, df in products.items():
        writer = df.write.mode(mode).format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        columns = (partition_by or {}).get(name)
        (writer.partitionBy(*columns) if columns else writer).save(f"{folder}/{name}")


def check_stored(spark: SparkSession, folder: str, required: Sequence[str]) -> None:
    """Every required product is stored under ``folder`` as parquet and holds rows; the error lists all that are not."""
    missing, empty = [], []
    for name in sorted(set(required)):
        try:
            found = spark.read.parquet(f"{folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            missing.append(name)
            continue
        if found.isEmpty():
            empty.append(name)
    if missing or empty:
        raise QualityError(f"missing products: {missing}; empty products: {empty}")


def expected_predictions(spark: SparkSession, models: Sequence[str], horizons: Sequence[int], start, end,
                         series: DataFrame | None = None) -> DataFrame:
    """The contract of a run: every (series, model, horizon, target day) that has to be stored."""
    grid = (series if series is not None else spark.range(1).select()).distinct()
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(int(h)).alias("horizon")) for m in models for h in horizons])
    return grid.select("*", F.inline(pairs)).select(
        "*", F.explode(F.sequence(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))).alias("target"))


def missing_from(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected rows without a stored one; a null is a value like any other."""
    return join_keys(expected, stored.select(*expected.columns), expected.columns, how="left_anti")


def append_run(predictions: DataFrame, metrics: DataFrame, config: Mapping, folder: str, run_id: str | None = None,
               expected: DataFrame | None = None) -> str:
    """Store a run under its own id; an existing run is never overwritten.

    ``expected`` is stored with the run and compared with what was stored, not with
    what was meant to be: rows of it that the written predictions lack, or pairs that the written
    metrics lack, are an error.  The configuration is written last: a run counts only
    when all tables are there and the contract holds, so a broken run is never read.
    """
    run = run_id or f"{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}_{uuid.uuid4().hex[:8]}"
    spark = predictions.sparkSession
    settings = spark.range(1).select(F.lit(json.dumps(dict(config), default=str, ensure_ascii=False)).alias("config"))
    place = lambda name: f"{folder}/{name}/run_id={run}"
    for name, df in (("predictions", predictions), ("metrics", metrics), ("contract", expected)):
        if df is not None:
            df.write.mode("errorifexists").parquet(place(name))
    if expected is not None:
        contract = spark.read.parquet(place("contract"))
        require(missing_from(spark.read.parquet(place("predictions")), contract), "stored predictions miss expected rows")
        stored = spark.read.parquet(place("metrics"))
        pairs = contract.select(*[c for c in contract.columns if c in stored.columns]).distinct()
        require(missing_from(stored, pairs), "stored metrics miss expected pairs")
    settings.write.mode("errorifexists").parquet(place("config"))
    return run


def read_runs(spark, folder: str, name: str) -> DataFrame:
    """All complete runs of a product; ``run_id`` is a partition column."""
    runs = spark.read.parquet(f"{folder}/{name}")
    if name == "config":
        return runs
    complete = spark.read.parquet(f"{folder}/config").select("run_id").distinct()
    return runs.join(complete, "run_id", "left_semi").select(*runs.columns)
