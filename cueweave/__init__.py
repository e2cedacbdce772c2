"""Timed-text (subtitle and caption) analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the few Python helpers with the task instead of asking every executor
# to have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
