"""Operators of a training-data pipeline over documents, embeddings and pages."""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel to the executors by value, so no executor needs it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
