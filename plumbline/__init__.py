"""plumbline: a Spark-native document-similarity analytics engine.

The library proper lives in ``sources`` (ingest), ``functions`` (scalar text
functions and kernels), ``operators`` (candidates, scoring, graph, ranking,
assignment), ``plans`` (composed queries and their SQL), ``streaming`` and
``report``.  ``llm`` is a separable subpackage of training-data operators that
nothing else imports.
"""

__version__ = "0.1.0"
