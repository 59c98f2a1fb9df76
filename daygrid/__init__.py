"""daygrid: event-count and sensor panels on Spark.

Every operator is a lazy ``DataFrame -> DataFrame`` function.  A *panel* is a
DataFrame with zero or more key columns, one ``date`` column and measures; a
single series is the panel with ``keys=[]``.
"""

__version__ = "0.1.0"
