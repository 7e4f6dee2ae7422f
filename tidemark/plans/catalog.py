"""All registered queries."""

from tidemark.plans import catalog_plans, factor_plans, finance, ingest_plans, relational, research, selection_plans, snapshot_plans, windowed  # noqa: F401  (they register themselves)
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
