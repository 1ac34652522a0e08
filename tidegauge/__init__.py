"""tidegauge: observability analytics (metrics, logs, traces, detection) expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions for Python workers travel by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
