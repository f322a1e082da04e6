"""Operators for training-data pipelines. Nothing outside this subpackage
imports it; ``__spark_entry__`` adds its queries when it is present."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors with the tasks, so the
# package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
