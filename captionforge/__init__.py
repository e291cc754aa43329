"""Image-caption dataset engine on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The small functions that run in Python workers travel with the tasks, so the package need not
# be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
