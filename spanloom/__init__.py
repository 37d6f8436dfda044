"""Annotation analytics on Spark: spans, lexicons, similarity joins, evaluation, scorecards and resampling statistics."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel whole, so that the executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
