"""folioscope: document analytics, retrieval and knowledge-graph operators on Spark DataFrames."""

__version__ = "0.1.0"

import sys

try:  # functions of this package travel to the Python workers whole, so that these need not have it installed
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
except ImportError:
    pass
