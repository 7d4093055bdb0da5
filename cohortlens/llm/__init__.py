"""Operators for preparing large text corpora.  Nothing else in the library imports this subpackage.

Task functions of this subpackage are shipped to executors by value, so a cluster needs no installed copy.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
