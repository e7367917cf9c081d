"""Operators on training corpora. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Executors get these functions by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
