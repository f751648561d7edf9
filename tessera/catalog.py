"""All queries of the engine and their SQL."""

from __future__ import annotations

from .plans import flows, graphs, io, learning, pairing, scalar
from .plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flows", "graphs", "io", "learning", "pairing", "scalar"]
