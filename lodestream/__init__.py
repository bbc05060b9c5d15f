"""lodestream: a PySpark-native analytics engine for evidence retrieval and evaluation.

Operators are functions from DataFrame to DataFrame (:mod:`lodestream.operators`),
expressions are functions from Column to Column (:mod:`lodestream.functions`), readers and
writers live in :mod:`lodestream.sources`, whole queries in :mod:`lodestream.plans` and the
Structured Streaming forms in :mod:`lodestream.streaming`.
"""

__version__ = "0.1.0"
