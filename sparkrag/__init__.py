"""Document retrieval and corpus analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
