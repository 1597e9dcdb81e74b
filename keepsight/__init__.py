"""keepsight: a Spark-first engine for spatio-temporal object memories.

Functions of this package are shipped to Python workers by value, so executors
need no copy of the package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
