"""Operators for preparing language-model training data.

Worker functions of this subpackage travel to the executors by value, so a
cluster needs the third-party libraries but not a copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
