"""Filing analytics as DataFrame plans: facts, chunks, retrieval, evaluation."""

import sys

from pyspark import cloudpickle

# Executors need not have this package on their path: functions that are sent
# to Python workers are pickled by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
