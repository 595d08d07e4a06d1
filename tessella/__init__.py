"""tessella: a Spark-native engine for spatial, temporal and tagged-feature analytics."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
