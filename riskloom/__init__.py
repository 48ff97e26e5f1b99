"""riskloom: similarity-based risk scoring and text-corpus operators as Spark DataFrame plans.

What tasks need of this package travels with them by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
