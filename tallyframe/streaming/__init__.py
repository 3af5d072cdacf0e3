"""Structured Streaming jobs: file-drop ingest, hour-slot totals, order dedupe (ST-01…03)."""
