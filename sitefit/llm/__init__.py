"""Operators of a training-data pipeline over a table of documents.

Functions that run in Python workers travel with their job, so the package need not be installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
