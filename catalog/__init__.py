"""Registered queries, each with the SQL that gives the same rows in DuckDB."""

from catalog import base, crawling, parsing, platforms, storing, structure, tables  # noqa: F401

QUERIES = base.QUERIES
ORACLES = base.ORACLES
