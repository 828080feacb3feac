"""Spark-native engine for messy, multi-source entity metadata."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel with their code: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
