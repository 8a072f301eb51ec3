"""Training-data pipeline operators (one module per operator, ``queries`` registers them)."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
