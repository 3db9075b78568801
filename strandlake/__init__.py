"""Spark-native engine for chunk deduplication and sequence data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry the package's code with them: it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
