"""Listings analytics on Spark: extract, normalise, de-duplicate, merge, search, rank, report."""

import sys

from pyspark import cloudpickle

# the few functions that run in Python workers travel with the task, so that executors need
# no copy of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
