"""Triage analytics on Spark: deduplication, sampling, evaluation, resampling and run-log auditing as DataFrame programs."""

import sys

from pyspark import cloudpickle

# the package's functions travel to Python workers by value, so executors need no copy of it on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
