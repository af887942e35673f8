"""Operators for large text corpora.

Functions of this package run inside Spark's Python workers; they travel by
value, so that executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
