"""A PySpark-native analytics engine for property-listing data.

The functions that run in Python workers are sent by value, so a cluster needs no copy of this
package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
