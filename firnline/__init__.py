"""firnline: velocity time-series analytics and training-data operators on Spark."""

from pyspark import cloudpickle as _cloudpickle

# Executors need no copy of this package: functions travel by value.
import sys as _sys

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
