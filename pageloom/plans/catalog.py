"""Registered queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import document_plans, object_plans, reading_plans, rule_plans, text_plans, tree_plans  # noqa: F401  (they register)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
