"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from particlelake.plans import (  # noqa: F401
    aggregate_queries,
    analysis_queries,
    cluster_queries,
    decision_queries,
    file_queries,
    join_queries,
    particle_queries,
    record_queries,
)
from particlelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
