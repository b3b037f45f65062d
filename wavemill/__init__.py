"""Spark-native engine for measurement recordings and ordered multi-channel series.

Every operator takes and returns DataFrames; nothing runs until the caller acts on
the result.  Python functions that executors run are shipped by value, so executors
need numpy, pandas and pyarrow but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
