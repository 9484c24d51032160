"""Corpus ingest, retrieval and conversation analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python workers receive the few functions they run by value, so executors do
# not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
