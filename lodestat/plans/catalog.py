"""All registered queries; importing the query modules fills the registry."""

from lodestat.plans import queries_clean, queries_models, queries_results, queries_stats  # noqa: F401
from lodestat.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
