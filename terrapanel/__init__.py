"""Spatial panel analytics on Spark.

Gridded, areal and hourly sources become one entity-by-month panel; the panel is
rolled up, profiled, turned into features, ranked, modelled and explained. All
row-scale work is declared with the DataFrame API.
"""

import sys

from pyspark import cloudpickle

from terrapanel.session import checkpointed, get_session

# Functions that run inside tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session", "checkpointed"]
