"""Every registered query of the library, with its reference SQL."""

from __future__ import annotations

from . import classification, evaluation, extras, files, indexed, nested, parsing, relational, retrieval, rules, selection, streams, time_windows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
