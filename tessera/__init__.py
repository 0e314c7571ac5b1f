"""tessera — Spark-native automated tabular analytics.

Every public operator takes a Spark ``DataFrame`` (plus column-role
arguments) and returns a ``DataFrame``.  Work runs as distributed
aggregations, windows and joins over whole tables; only bounded,
k-sized results (one-row aggregates, per-column summaries) ever reach
the driver.
"""

__version__ = "0.1.0"
