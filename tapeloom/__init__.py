"""Search and upkeep of timed transcript collections on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Ship the small Arrow helpers to the executors with the task, so that a job
# needs no package install on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
