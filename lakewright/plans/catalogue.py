"""All registered queries; importing the plan modules fills the registry."""

from lakewright.plans import engines, records, relational, retrieval, sinks, stores, texts, vectors  # noqa: F401
from lakewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
