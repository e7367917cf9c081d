"""Registered queries: importing this package fills the catalog."""

from .catalog import ORACLES, QUERIES
from . import sources, projections, gates, joins, identity, aggregates, ranking, scalars, extraction, market, builders, contracts, streams  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
