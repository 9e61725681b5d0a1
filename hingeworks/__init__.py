"""Large-margin classification on Spark DataFrames.

Inputs are ``points`` tables: ``(id LONG, label DOUBLE, features ARRAY<DOUBLE>)``
with labels 0.0 / 1.0 and a unique ``id``.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions shipped to Python workers travel by value, so executors need no
# copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
