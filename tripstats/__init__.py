"""tripstats: ride-trip analytics on Spark.

Batch rollups (hourly/daily counts, duration histogram, route statistics,
hourly fare profile), the reports built on them, and Structured Streaming
jobs that keep the rollups current from a JSON change feed.  Every operator
is a ``DataFrame -> DataFrame`` function built from Spark SQL expressions.
"""

__all__ = ["config", "session"]
