"""tidemark: a Spark-first engine for market-style time series.

Candles become multi-pace state vectors, states are searched in a memory bank
by similarity, votes drive a position fold and the traces are aggregated into
diagnostics; beside these stand operators that clean time series at scale.
"""

import os
import sys

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # tasks are the parallelism; a pool of threads beside the JVM may stall

from pyspark import cloudpickle  # noqa: E402

#: Python workers need not have this package: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
