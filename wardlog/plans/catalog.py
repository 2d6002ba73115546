"""All registered queries."""

from wardlog.plans import q_attacks, q_learning, q_profile, q_scalars, q_sources, q_store, q_streams  # noqa: F401
from wardlog.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
