"""Evidence coverage on Spark.

Functions of this package travel to the tasks with their code, so executors
need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
