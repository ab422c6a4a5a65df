"""The registered queries and the SQL each is compared with."""

from palisade.plans.registry import ORACLE, QUERIES
from palisade.plans import flows, logs, models, stores, streams  # noqa: F401  (registering)

__all__ = ["ORACLE", "QUERIES"]
