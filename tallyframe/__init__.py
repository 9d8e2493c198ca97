"""Analytics operators for Spark: settlement reconciliation, and (in llm) the making of training data."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, so that it needn't be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
