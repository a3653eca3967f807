"""Spark-native ingest and search for hour-partitioned NDJSON event archives."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks carry their code, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
