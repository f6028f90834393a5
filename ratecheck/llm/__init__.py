"""Operators for training-data pipelines."""

import sys

from pyspark import cloudpickle

# Python workers get this subpackage's functions with the task and need not find it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
