"""Operators of a training-data pipeline; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions for the workers travel with their code, so that executors need not have this
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
