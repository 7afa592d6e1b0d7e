"""Data curation and drift analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from curadrift.session import build_session, checkpointed, small_side

__all__ = ["build_session", "checkpointed", "small_side"]

# Functions of this package travel to the Python workers by value, so the executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
