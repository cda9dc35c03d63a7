"""Registered queries by area. Importing this package fills the registry."""

from millrace.queries import dashboards, recipes, sources, tables, telemetry, web, writes  # noqa: F401
from millrace.queries._registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
