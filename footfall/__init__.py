"""Product analytics over event data, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python functions of the package travel with the task, so executors need
# neither the package nor the driver's working directory.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
