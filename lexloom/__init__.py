"""Lexical-semantic analytics and training-data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Workers need not have this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
