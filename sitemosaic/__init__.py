"""Multi-site causal analytics on Spark DataFrames.

Python helpers that run inside Arrow tasks are shipped by value, so executors
need no copy of this package.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
