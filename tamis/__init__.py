"""tamis: screening and ranking analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel with the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
