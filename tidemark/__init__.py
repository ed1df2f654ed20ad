"""Point-in-time panel analytics as composable PySpark DataFrame operators."""
import sys

from pyspark import cloudpickle

# Python workers get the few functions they run by value, so that no executor
# needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
