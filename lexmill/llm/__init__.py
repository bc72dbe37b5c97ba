"""Operators for training-data pipelines, with their queries."""

from . import queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
