"""Spark-native analytics for comparing language models on a corpus of texts."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
