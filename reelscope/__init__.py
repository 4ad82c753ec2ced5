"""Spark-native moment retrieval: frames, vectors and tasks as DataFrames, ranked answers out.

Workers get the functions of this package by value, so a job runs wherever its driver can import it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
