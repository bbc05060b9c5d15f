"""Operators for building training data at corpus scale.

Each module holds one operator with a general interface and the thin query that applies it to a
whole table. Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# Executors get the code of Arrow functions with the task, so they need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
