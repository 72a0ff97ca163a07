"""cohortlens: admissions analytics as Spark DataFrame jobs.

Modules:
  session      -- SparkSession settings and the shared checkpoint folder
  schemas      -- canonical StructTypes, keys and report thresholds
  sources      -- table loaders (driver-table projections, CSV, JSON, text)
  functions    -- reusable Column expressions (rounding, flags, bands, ...)
  operators    -- reports, import transforms, upserts, resolution, questions
  plans        -- the query registry and its DuckDB oracle SQL
  streaming    -- incremental import with Structured Streaming
"""

__version__ = "0.1.0"
