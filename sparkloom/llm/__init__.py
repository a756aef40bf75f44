"""Training-data operators.  Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so that a worker
# needs no copy of the repository on its own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
