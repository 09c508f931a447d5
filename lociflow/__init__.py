"""Single-particle localisation and trajectory analytics on Spark DataFrames."""
import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need not
# have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
