"""All registered queries; importing the query modules fills the registry."""

from pagetide.plans import monitor_queries, page_queries, run_queries, source_queries, stream_queries  # noqa: F401
from pagetide.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
