"""agentlake: a PySpark-native engine for the data and evaluation side of tool-using language-model agents."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
