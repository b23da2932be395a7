"""The registered queries with their SQL counterparts."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

from workload import browse_queries, filter_queries, order_queries, payload_queries, source_queries, write_queries  # noqa: E402, F401
from workload.registry import ORACLES, QUERIES  # noqa: E402

__all__ = ["ORACLES", "QUERIES"]
