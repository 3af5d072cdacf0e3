"""tallyframe — operations-reporting jobs expressed as lazy Spark DataFrame transforms.

Layout:
  functions/  column expressions (casts, month keys, ratios, text rules)
  sources/    table reads, file landing reads, idempotent publish disciplines, ingest routing
  operators/  DataFrame -> DataFrame report transforms (one module per report family)
  plans/      stand-in frames over the supplied test tables and the query catalogue
  streaming/  Structured Streaming jobs (file-drop ingest, hour-slot totals, order dedupe)
"""

__version__ = "0.1.0"
