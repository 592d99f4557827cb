"""runlens: trace (run/span) analytics as Spark DataFrame jobs.

Layout:
  functions/  column expressions (scalars, JSON/VARIANT helpers)
  sources/    landing scans, run table, derived fixtures, sinks
  operators/  DataFrame -> DataFrame operators (errors, evaluation, merge, curation, stats, quality)
  plans/      end-to-end jobs (error report, detail report, dataset creation, ingest) + driver query catalog
  streaming/  incremental ingest of a landing folder (Structured Streaming + foreachBatch upsert)
"""

__all__ = ["session"]
