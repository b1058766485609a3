"""Loomery: a Spark-native analytics engine for tagged media and document libraries.

Functions that run on executors are sent by value, so that executors need Spark and the
scientific packages but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
