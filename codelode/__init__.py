"""Code-knowledge analytics on Spark: facts about source code as DataFrames, and bounded, deterministic questions about them."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions with the job, so that a cluster needs no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
