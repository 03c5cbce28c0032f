"""Exposure-safety cohort analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from sequela.config import StudyParams

# Python workers get these functions with the task, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["StudyParams"]
