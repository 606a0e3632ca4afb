"""Operators of a training-data pipeline (sharding, packing, extraction,
language, personal data, quality, mixing, near and exact duplicates, language
model scoring) and the queries that run them over whole tables.

Nothing else in the library imports this package.  Its task functions are
pickled by value, so executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
