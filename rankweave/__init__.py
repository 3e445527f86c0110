"""Retrieval, personalization and training-set jobs as PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the workers by value, so executors need no copy of it on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
