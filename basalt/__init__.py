"""A relational analytics engine on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the plan, so that a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
