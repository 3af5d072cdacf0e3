"""Stand-in frames over the test tables, DuckDB oracle CTEs and the query catalogue."""
