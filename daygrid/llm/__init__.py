"""Operators for preparing training text.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Worker functions travel with what they use: a cluster ships no copy of the package by itself.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
