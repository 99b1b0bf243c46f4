"""lossledger — insurance-claims analytics as Spark DataFrame jobs.

Layers:
  sources/    driver tables -> raw claims tables, literal reference tables
  functions/  column expressions (money rounding, calendar, tier ladders)
  operators/  reusable DataFrame operators (surrogate keys, latest-per-key,
              bounded broadcast lookups, upsert, profiling)
  plans/      star schema, reports, semantic layer, data-quality checks
  streaming/  change-feed upsert with Structured Streaming
"""

from lossledger.context import Context

__all__ = ["Context"]
