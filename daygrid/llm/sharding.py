"""Byte-bounded shards by extendible hashing, with DataFrame expressions only.

Every row has 60 hash bits.  The directory is a table of buckets (hash prefix,
depth): it begins with one bucket, and only a bucket above the byte limit is
split on one more bit.  Sizes are summed once for fine cells (a prefix some
bits longer than the expected depth) and added up for all shorter prefixes, so
all the splits of those bits cost one pass over the rows; cells still too large
are taken apart by further bits in further rounds over their rows alone.

A bucket whose rows all have one hash (repeated rows) cannot be split: its rows
are dealt to overflow pages of at most the limit, computed from their number.

Defined results: null texts have no bytes; a single row above the limit is a
shard of its own; rows equal in id and text share a bucket; an empty table gives
no rows; other columns are ignored by :func:`assign` and kept by :func:`write_shards`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from daygrid.llm.catalog import query, table
from daygrid.stage import stage

BITS = 60
FINER = 6  # bits of the cells beyond the depth that even hashing would need
SHARD_BYTES = 16 << 20


def hash_bits(key: str, text: str) -> Column:
    """60 bits of the MD5 of id and text."""
    whole = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, BITS // 4), 16, 10).cast("long")


def _prefix(bits: Column, depth) -> Column:
    depth = depth if isinstance(depth, Column) else F.lit(depth)
    return F.call_function("shiftright", bits, (F.lit(BITS) - depth).cast("int"))


def _leaves(cells: DataFrame, fine: int, above: int, limit: int) -> DataFrame:
    """(cell, depth, fits): for every cell the first depth beyond ``above`` at which its bucket fits."""
    at = cells.withColumn("depth", F.explode(F.sequence(F.lit(above), F.lit(fine)))).withColumn(
        "bucket", F.call_function("shiftright", F.col("cell"), (F.lit(fine) - F.col("depth")).cast("int")))
    sizes = at.groupBy("depth", "bucket").agg(
        F.sum("bytes").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    good = sizes.where((F.col("total") <= limit) | (F.col("low") == F.col("high"))).select("depth", "bucket")
    first = at.join(good, ["depth", "bucket"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(first, "cell", "left")


def assign(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(key, n_bytes, depth, shard, page) of every row; ``shard`` is the bucket's prefix as a string of bits.

    ``row``, a column of stored numbers that tell all rows apart, is carried along.
    """
    own = [F.col(row).alias("row")] if row else []
    rows = stage(docs.select(  # three numbers a row: the texts are read once
        F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        hash_bits(key, text).alias("bits"), *own))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    fine = min(BITS, max(1, -(-total // limit)).bit_length() + FINER)
    above, placed, left = 0, None, rows
    while True:
        cells = stage(left.groupBy(_prefix(F.col("bits"), fine).alias("cell")).agg(
            F.sum("n_bytes").alias("bytes"), F.min("bits").alias("low"), F.max("bits").alias("high")))
        leaves = stage(_leaves(cells, fine, above, limit))
        met = left.withColumn("cell", _prefix(F.col("bits"), fine)).join(leaves, "cell").drop("cell")
        done = met.where("depth is not null")
        placed = done if placed is None else placed.unionByName(done)
        if fine == BITS or not leaves.where("depth is null").limit(1).count():
            break
        left = stage(met.where("depth is null").drop("depth"))
        above, fine = fine + 1, min(BITS, fine + FINER)
    bucket = placed.withColumn("bucket", _prefix(F.col("bits"), F.col("depth")))
    return _with_pages(bucket, limit).select(
        F.col("key").alias(key), "n_bytes", F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") == 0, F.lit("")).otherwise(
            F.lpad(F.conv(F.col("bucket").cast("string"), 10, 2), F.col("depth").cast("int"), F.lit("0"))).alias("shard"), "page",
        *([F.col("row").alias(row)] if row else []))


def _with_pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages for buckets of one hash whose rows exceed the limit together."""
    same = rows.groupBy("depth", "bucket").agg(F.sum("n_bytes").alias("total"), F.count("*").alias("n"))
    full = stage(same.where((F.col("total") > limit) & (F.col("n") > 1)).select("depth", "bucket"))
    plain = rows.join(full, ["depth", "bucket"], "left_anti").withColumn("page", F.lit(0).cast("long"))
    met = rows.join(full, ["depth", "bucket"])
    each = F.greatest(F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))), F.lit(1))
    if "row" in rows.columns:
        counted = _numbered(met, ["key", "n_bytes", "bits", "depth", "bucket"])
    else:
        groups = met.groupBy("key", "n_bytes", "bits", "depth", "bucket").agg(F.count("*").alias("n"))
        counted = groups.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    dealt = counted.withColumn("page", F.floor(F.col("i") / each).cast("long"))
    return plain.unionByName(dealt.select(*plain.columns))


SLICE = 1 << 16  # row numbers of a slice


def _numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Add ``i``, the place among the rows alike in ``by``: counted in slices of row numbers, whose totals are carried over."""
    rows = stage(rows.withColumn("slice", F.floor(F.col("row") / SLICE)))
    alike = [F.hash(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c == "key" else F.col(c) for c in by]
    rows = rows.withColumn("alike", F.struct(*alike))
    counts = rows.groupBy("alike", "slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("alike").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("alike", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("alike", "slice").orderBy("row")
    return rows.join(before, ["alike", "slice"]).withColumn("i", F.col("before") + F.row_number().over(inside) - 1)


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> None:
    """One folder of JSON lines per shard; every row and column of ``docs`` is kept, whatever its key."""
    held = stage(docs.withColumn("_row", F.monotonically_increasing_id()))
    shards = assign(held, limit, key, text, "_row").select(
        "_row", F.concat_ws("-", F.format_string("s%s", "shard"), F.col("page").cast("string")).alias("_shard"))
    held.join(shards, "_row").drop("_row").repartition("_shard").write.partitionBy("_shard").json(path)


SMALL_SHARD_BYTES = 1 << 16  # splits small tables too


def _assign_sql(limit: int) -> str:
    return f"""
WITH rows AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
                     CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS bits
              FROM documents),
buckets AS (SELECT CAST(d AS INTEGER) AS d, bits >> (60 - CAST(d AS INTEGER)) AS p, sum(n_bytes) AS total, min(bits) = max(bits) AS same
            FROM rows, (SELECT unnest(range(0, 41)) AS d) GROUP BY 1, 2),
leaves AS (SELECT doc_id, n_bytes, bits, min(d) AS depth FROM rows JOIN buckets ON p = bits >> (60 - d)
           WHERE total <= {limit} OR same GROUP BY 1, 2, 3)
SELECT doc_id, n_bytes, CAST(depth AS BIGINT) AS depth,
       CASE WHEN depth = 0 THEN '' ELSE lpad(format('{{:b}}', bits >> (60 - depth)), depth, '0') END AS shard, CAST(0 AS BIGINT) AS page
FROM leaves"""


@query("op6_sharding", _assign_sql(SHARD_BYTES))
def op6(spark, sf_dir) -> DataFrame:
    """The shard of every document."""
    return assign(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("sharding_64k", _assign_sql(SMALL_SHARD_BYTES))
def small_shards(spark, sf_dir) -> DataFrame:
    """The same for shards of 64 KiB, so that buckets split at every size of the tables."""
    return assign(table(spark, sf_dir, "documents", "doc_id", "text"), SMALL_SHARD_BYTES)
