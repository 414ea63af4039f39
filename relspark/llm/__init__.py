"""Operators for preparing large text corpora. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# tasks take these modules along by value, so the executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
