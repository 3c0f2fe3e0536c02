"""Bank reconciliation and cash-flow analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python workers get the package's task functions inside the job, so a cluster
# needs no extra files on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
