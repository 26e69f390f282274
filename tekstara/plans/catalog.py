"""All registered queries of the library and the SQL that says the same."""

from __future__ import annotations

from . import accent, corpus, evaluation, generators, lexicon, lexicon_joins, lines, metrics, sequences, text  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
