"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from daygrid.catalog import (  # noqa: F401
    evaluation, forecasting, preparation, rollups, statistics, timeseries)
from daygrid.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
