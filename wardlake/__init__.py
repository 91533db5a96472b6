"""Policy, DLP and audit analytics on Spark."""

import sys

from pyspark import cloudpickle

# Python workers get the few functions and state processors by value, so they need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
