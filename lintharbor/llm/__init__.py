"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Its functions are sent to the executors by value, so tasks need no copy of the package there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
