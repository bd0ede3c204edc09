"""All registered queries."""

from __future__ import annotations

from . import q_cluster, q_columns, q_models, q_stats, q_timeline, q_wide  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
