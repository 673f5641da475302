"""tidemark: point-in-time panel analytics on Spark DataFrames.

Python workers receive this package's functions by value, so executors need
neither an installed copy nor the driver's working directory.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
