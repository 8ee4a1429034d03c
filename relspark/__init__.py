"""Relationship analytics between objects, expressed as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# tasks carry the few Python functions they run, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
