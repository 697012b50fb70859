"""A PySpark-native engine for lap timing, car telemetry and the text corpora built from them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
