"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
