"""Queries over the driver's tables and the SQL they are checked against."""

from emberline.catalog import q_learning, q_sources, q_streams, q_zones  # noqa: F401  (they register)
from emberline.catalog.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
