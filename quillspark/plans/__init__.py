"""Registered queries over the driver's tables, with the SQL that must give the same rows."""

from . import chat, corpus, retrieval
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "chat", "corpus", "retrieval"]
