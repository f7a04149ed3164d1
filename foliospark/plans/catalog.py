"""Every registered query by name, with the SQL that must give the same rows."""

from __future__ import annotations

from . import cascade_plans, relation_plans, report_plans, text_plans  # noqa: F401  they register what they define
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
