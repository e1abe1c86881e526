"""Named queries and, where SQL can state them, their equivalents."""

from sparkveil.plans.oracles import ORACLES
from sparkveil.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
