"""stockflow: Spark-native analytics for parts stock and service work.

Layout:
  sources/    raw scans (S1), the domain tables, sinks and stream sources
  functions/  Column-level scalar rules (X1-X14) and enum codes
  operators/  set-at-a-time jobs: filters, joins, aggregates, folds, checks
  plans/      the query registry and the DuckDB oracle texts
  streaming/  Structured Streaming jobs (T1-T7)
"""

from stockflow.session import get_spark

__all__ = ["get_spark"]
