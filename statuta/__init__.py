"""Statuta: ingesting, searching and auditing hierarchical regulatory texts on Spark."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions with the tasks, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
