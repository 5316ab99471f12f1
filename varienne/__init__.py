"""Varienne: ensemble analytics and variance-based sensitivity on Spark.

DataFrames in, DataFrames out.  Histories of many runs are scanned, derived,
unnested and aggregated by Spark; polynomial-chaos fits start from sufficient
statistics that Spark sums per (strategy, group, output), so only systems with
one row and column per polynomial term are ever solved inside a task.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run inside tasks travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
