"""Spark-native analytics for mobile air-quality measurements in a city.

Every operator takes DataFrames and returns a DataFrame; nothing runs on the
driver except the small, size-checked lookups named in the operator docs.
"""

import sys

from pyspark import cloudpickle

from plumewalk.session import durable, get_session

# Block kernels travel to the executors by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["durable", "get_session"]
