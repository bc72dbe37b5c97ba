"""Named queries over the input tables and their DuckDB equivalents."""

from . import evaluation, gating, ingest, integrity, packing, retrieval, routing, streams, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
