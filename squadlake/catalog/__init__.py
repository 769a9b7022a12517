"""Queries over the given tables, one per operator, with SQL oracles."""

from squadlake.catalog import raw, rules, series, warehouse  # noqa: F401
from squadlake.catalog.registry import ORACLES, QUERIES  # noqa: F401
