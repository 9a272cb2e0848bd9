"""blockloom: turns raw web pages and noisy candidate labels into records, on Spark.

Every public function takes and returns DataFrames (or Columns); nothing here
collects rows to the driver except bounded ones (class plans, the vocabulary).
Functions that run in Python workers are sent there with their code, so that
executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
