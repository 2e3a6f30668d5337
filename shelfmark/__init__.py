"""shelfmark: bibliographic corpus analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
