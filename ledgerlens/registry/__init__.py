"""Every query by name. Importing this package registers all of them."""

from ledgerlens.registry import analyses, expressions, joins, models, sources
from ledgerlens.registry.core import CHECKS, QUERIES, check_sql

__all__ = [
    "CHECKS",
    "QUERIES",
    "analyses",
    "check_sql",
    "expressions",
    "joins",
    "models",
    "sources",
]
