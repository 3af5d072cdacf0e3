"""Query definitions; importing this package registers every query in the catalogue."""
from . import q_bets, q_clean, q_ingest, q_member, q_misc, q_newreg, q_ops, q_pnl, q_publish, q_service, q_stream  # noqa: F401
