"""Registered queries over the supplied tables, each next to its SQL twin."""

from folioguard.plans import flows, governance, intake, quality, rules, summaries  # noqa: F401
from folioguard.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
