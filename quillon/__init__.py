"""Model-knowledge analytics and corpus processing on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions of it travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
