"""All registered queries over the driver's tables."""

from attesta.plans import batch_queries, brief_queries, extra_queries, history_queries, ledger_queries, profile_queries, publication_queries, registry_queries, scalar_queries, support_queries, view_queries, walk_queries  # noqa: F401
from attesta.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
