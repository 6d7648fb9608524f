"""Gleaner: a PySpark-native engine for posting analytics and training-data preparation."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
