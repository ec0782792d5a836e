"""Spark-native engine for evidence-backed belief registries."""

import sys

from pyspark import cloudpickle

# Functions go to the workers by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
