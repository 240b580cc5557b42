"""Paired-evaluation analytics on Spark DataFrames."""

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to the workers by value: an executor needs no copy of it.
_cloudpickle.register_pickle_by_value(__import__(__name__))
