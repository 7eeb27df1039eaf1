"""Every operator as a named query over the driver's tables."""

from alarmlake.catalog import event_queries, job_queries, metrics_queries, rule_queries  # noqa: F401
from alarmlake.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
