"""All queries of the library and their SQL equivalents."""

from __future__ import annotations

from lakecairn.plans import q_content, q_counters, q_history, q_listing, q_maps, q_store, q_streams, q_tree, q_values, q_versions  # noqa: F401
from lakecairn.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
