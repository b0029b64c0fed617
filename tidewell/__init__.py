"""tidewell: incremental table ingest and exact document retrieval on Spark."""

import sys

from pyspark import cloudpickle

# Python workers get the few functions they run inside the task itself, so a
# cluster needs no copy of this package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
