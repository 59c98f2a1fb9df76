"""File listings: yearly station files, fingerprints and the source manifest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from daygrid.operators.blocks import attach
from daygrid.operators.quality import QualityError
from daygrid.operators.rollup import target_profile

# Bytes of a file that a worker holds at a time.
BLOCK_BYTES = 4 << 20


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Paths and sizes under a folder, at any depth; the contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
            .load(folder).select("path", "length"))


def station_files(spark: SparkSession, folder: str, glob: str, year_pattern: str, years: Sequence[int]) -> DataFrame:
    """Per expected year: how many files carry the year in their name and lie in that year's folder."""
    name, parent = F.element_at(F.split("path", "/"), -1), F.element_at(F.split("path", "/"), -2)
    year = F.regexp_extract(name, year_pattern, 1)
    files = (list_files(spark, folder, glob).withColumn("year", year)
             .where((F.col("year") != "") & (parent == F.col("year")))
             .select(F.col("year").cast("int").alias("year"), "path"))
    found = files.groupBy("year").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("path"))
    wanted = spark.range(min(years), max(years) + 1).select(F.col("id").cast("int").alias("year"))
    return (wanted.where(F.col("year").isin(list(years))).join(found, "year", "left")
            .withColumn("files", F.coalesce("files", F.lit(0))))


def select_station_files(spark: SparkSession, folder: str, glob: str, year_pattern: str, years: Sequence[int]) -> list[str]:
    """Exactly one path per year, or an error that lists missing and repeated years."""
    rows = station_files(spark, folder, glob, year_pattern, years).orderBy("year").collect()  # one row per year
    missing = [r.year for r in rows if r.files == 0]
    repeated = [r.year for r in rows if r.files > 1]
    if missing or repeated:
        raise QualityError(f"station files: missing years {missing}; repeated years {repeated}")
    return [r.path for r in rows]


def _opener():
    """A function for workers: a listed file as a stream, its bytes as they are stored or ``unpacked``."""

    def stream(path: str, unpacked: bool = False):
        import re
        from urllib.parse import quote

        from pyarrow.fs import FileSystem

        local = re.sub("^file:/+", "/", path)
        system, place = FileSystem.from_uri(local if local.startswith("/") else quote(path, safe=":/"))
        return system.open_input_stream(place, compression="detect" if unpacked else None)

    return stream


def _digests(block: int):
    """The worker function: reads each listed file in blocks, so memory does not grow with a file."""
    opened = _opener()

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for frame in frames:
            found = []
            for path in frame["path"]:
                total = hashlib.sha256()
                with opened(path) as stream:
                    while data := stream.read(block):
                        total.update(data)
                found.append(total.hexdigest())
            yield frame.assign(sha256=found)[["file", "length", "sha256"]]

    return digest


def _first_lines(block: int):
    """The worker function: the first line of each listed file that is not blank, read no further than that."""
    opened = _opener()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for path in frame["path"]:
                with opened(path, unpacked=True) as stream:
                    data = stream.read(block).lstrip()
                    while b"\n" not in data and (more := stream.read(block)):
                        data = (data + more).lstrip()
                found.append(data.split(b"\n", 1)[0].rstrip())
            yield frame.assign(header=found)[["header", "path"]]

    return read


def files_by_header(spark: SparkSession, paths: Sequence[str], block: int = 1 << 16) -> list[list[str]]:
    """The files behind ``paths`` (files, folders or patterns), those with one first line together, in one job.

    Files without any line are left out.  Only names reach the driver, as with every scan.
    """
    files = spark.read.format("binaryFile").load(list(paths)).select("path")
    lines = files.repartition(F.xxhash64("path")).mapInPandas(_first_lines(block), "header binary, path string")
    groups = lines.where(F.length("header") > 0).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return [row["paths"] for row in groups.orderBy("header").collect()]


def fingerprint_files(spark: SparkSession, folder: str, glob: str = "*", block: int = BLOCK_BYTES) -> DataFrame:
    """(file, length, sha256) of every file under a folder, whatever its size; ``file`` is the path below the folder.

    Only paths are shuffled, one small row per file; a worker streams the bytes.
    """
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    below = F.substring_index("path", root + "/", -1)
    files = list_files(spark, folder, glob).select(below.alias("file"), "length", "path")
    dealt = files.repartition(F.xxhash64("path"))
    return dealt.mapInPandas(_digests(block), "file string, length long, sha256 string")


def source_manifest(daily: DataFrame, value: str, time: str, raw_rows: DataFrame, files: DataFrame,
                    definition: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """Summary and file digests of a run, two tables that share ``run_id``.

    The summary is one row: target definition, period, rows of the event source (``raw_rows``, a
    one-row count), profile of the target, number and bytes of the files.  The
    list has one row per input file, however many there are.
    """
    profile = target_profile(daily, value)
    period = daily.agg(F.min(time).alias("start"), F.max(time).alias("end"))
    sizes = files.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    one = daily.sparkSession.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(definition).alias("target"), raw_rows.scalar().alias("raw_rows"))
    for part in (period, profile, sizes):
        one = attach(one, part, [])
    return one, files.select(F.lit(run_id).alias("run_id"), "file", "length", "sha256")
