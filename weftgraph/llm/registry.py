"""All queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import queries_native, queries_python

QUERIES = {**queries_native.QUERIES, **queries_python.QUERIES}
SQL = {**queries_native.SQL}
