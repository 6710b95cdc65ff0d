"""Spark-native analytics for intention graphs over e-commerce behaviour."""

import sys

from pyspark import cloudpickle

# functions of this package travel to executors by value, so that it need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
