"""codequarry: repository intelligence as Spark jobs over tables of many repositories."""

import sys

from pyspark import cloudpickle

# Task-side helpers (data source, ordered folds, stream processors) travel by value, so
# executors need nothing installed beyond PySpark, pandas and pyarrow.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
