"""lingomesh — cross-language page matching as Spark DataFrame jobs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package that run inside Python workers (Arrow kernels, grouped
# maps) are shipped by value, so executors never need the package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
