"""One-class anomaly detection over large tables of text records, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Ship helper functions with the job, so that executors need no local install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
