"""A broadcast row filter of bounded size, for joins that need few rows of a wide table.

Keys are hashed to ``CELLS`` cells; the cells of the wanted keys, never more than
``CELLS`` numbers, are broadcast, and rows in other cells skip the shuffle.  It only
saves work: rows that share a cell by chance are told apart by the join itself,
and a filter that has filled up lets every row through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CELLS = 1 << 20


def cell(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(CELLS))


def only_listed(df: DataFrame, key: str, wanted: DataFrame, of: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among the values of ``of`` in ``wanted``."""
    cells = listed_cells(wanted.select(F.col(of).cast("long").alias("key")), "key")
    return df.join(cells, F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(CELLS)) == F.col("cell"), "left_semi")


def listed_cells(keys: DataFrame, *cols: str) -> DataFrame:
    """One column ``cell``: the cells of the given rows, to be joined by broadcast."""
    return F.broadcast(keys.select(cell(*cols).alias("cell")).distinct())
