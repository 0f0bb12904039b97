"""attesta: evidence-backed entity profiles on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel by value, so executors need Spark and
# the third-party wheels only, not a copy of this repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
