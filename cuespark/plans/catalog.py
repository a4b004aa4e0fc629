"""Registered queries of the engine's own operators and their oracles."""

from cuespark.plans.oracles import ORACLES
from cuespark.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
