"""Imports every module that registers queries."""

from cohortspark.plans import evaluating, extraction, features, labelling, sourcing  # noqa: F401
from cohortspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
