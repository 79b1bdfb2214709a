"""Queries over the driver's tables, one per operator, and their SQL counterparts."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
