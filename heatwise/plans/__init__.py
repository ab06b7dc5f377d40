"""Registered queries, each with its SQL twin where SQL can express it."""

from . import features, flows, scalars, tables
from .base import QUERIES, SQL
from .tables import flagship

__all__ = ["QUERIES", "SQL", "features", "flagship", "flows", "scalars", "tables"]
