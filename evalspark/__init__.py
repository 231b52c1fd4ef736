"""Spark-native building, checking and grading of evaluation sets.

Every operator takes DataFrames and returns a DataFrame.  ``functions`` holds
Column expressions, ``operators`` the DataFrame operators, ``sources`` the
readers and writers, ``plans`` the queries over the shared test tables.
"""

import sys

from pyspark import cloudpickle

# Ship our task functions by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
