"""glean: corpus retrieval and risk analytics as Spark DataFrame jobs.

* ``glean.functions``: Column -> Column functions (text, paths, logs, code tokens).
* ``glean.operators``: DataFrame -> DataFrame operators (keyword index and
  search, nearest neighbours, evaluation, histories, balanced ordered
  computations, risk statistics and models, metrics, chunking, patches).
* ``glean.sources``: driver tables, corpus reads and sinks, the tree source.
* ``glean.streaming``: incremental operators on Structured Streaming.
* ``glean.plans``: the registered queries and their DuckDB oracle SQL.
"""

__version__ = "0.1.0"
