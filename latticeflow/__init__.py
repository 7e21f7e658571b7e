"""latticeflow: a Spark-native engine for curating training sets from molecular complexes and text.

Functions that run in Python workers are pickled by value, so a cluster needs no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
