"""Operators of a training-data pipeline, with their queries."""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
