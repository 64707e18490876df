"""windrow: forecast analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# vectorised kernels travel to the executors by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
