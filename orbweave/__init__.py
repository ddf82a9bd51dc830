"""A PySpark-native analytics engine for scene-aware asset retrieval data."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in tasks travel with their code, wherever workers start.
register_pickle_by_value(sys.modules[__name__])
