"""Query-directed morphological text search, and corpus operators, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: functions and classes of it travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
