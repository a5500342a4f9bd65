"""Spark-native engine for agent memory: retrieval, maintenance, import and corpus work."""

import sys

from pyspark import cloudpickle

# functions shipped to executors travel by value, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
