"""Operators for training-text pipelines: documents, pages and conversations in, DataFrames out.

Task functions travel to the executors by value, so workers need only the public
libraries they import, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
