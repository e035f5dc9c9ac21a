"""Capacity-constrained selection and group-disparity analytics on Spark."""

import sys

from pyspark import cloudpickle

# executors need not have this package: its functions travel with the jobs that use them
cloudpickle.register_pickle_by_value(sys.modules[__name__])
