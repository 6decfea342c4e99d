"""Facts, rules and citable text as Spark jobs: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

from factline.sources.tables import Tables

# Python functions travel to the executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Tables"]
