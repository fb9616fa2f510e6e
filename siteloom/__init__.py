"""siteloom: search-operations analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need nothing of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from siteloom.session import build_session, stage  # noqa: E402

__all__ = ["build_session", "stage"]
