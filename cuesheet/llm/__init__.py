"""Training-data operators: cleaning, de-duplication, classification, mixing and search."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel inside the plan, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
