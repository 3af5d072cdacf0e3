"""Column expressions: ``exprs`` (casts, dates, keys, ratios) and ``text`` (conversation rules)."""
from . import exprs, text  # noqa: F401
