"""Operators for preparing training text, and the queries that apply them to the given tables."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors whole, which therefore need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
