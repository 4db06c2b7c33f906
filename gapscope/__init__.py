"""Support-ticket knowledge coverage on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from gapscope.config import Thresholds

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Thresholds"]
