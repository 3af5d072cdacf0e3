"""Table reads, landed-file reads, ingest routing and idempotent publish disciplines."""
