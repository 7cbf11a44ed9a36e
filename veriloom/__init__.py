"""A PySpark-native engine for evidence-backed facts.

Python code that runs on executors is shipped by value, so a cluster needs no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
