"""haulbook: bulk object transfers and their ledger, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Ship the package's functions with the task, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
