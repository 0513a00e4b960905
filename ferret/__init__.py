"""ferret: federated-search data work (hits, resources, index, selection) on Spark.

Functions that run in Python workers (``mapInPandas``, stateful streaming
processors) are shipped with the task by value, so executors need no copy of
this package installed.
"""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
