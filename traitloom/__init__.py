"""traitloom: statistical genetics of molecular traits as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so executors need neither
# the package installed nor the driver's working directory.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
