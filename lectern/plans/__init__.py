"""Registered queries. Importing this package registers all of them."""

from lectern.plans import ingest, reports, scoped, search, talk  # noqa: F401
from lectern.plans.registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
