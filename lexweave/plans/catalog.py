"""The registered queries of the library and their oracle SQL.

Queries come in modules by theme; a query is registered together with the SQL
that must give the same rows, or without any where SQL has no such form.
"""

from __future__ import annotations

from . import lookup, quality, scalar, sources

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (lookup, quality, scalar, sources):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
