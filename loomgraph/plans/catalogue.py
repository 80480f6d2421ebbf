"""All queries over the graph of the tables, and the SQL they are held against."""

from __future__ import annotations

from . import exchange, functions, history, patterns, reasoning

QUERIES = {**patterns.QUERIES, **functions.QUERIES, **reasoning.QUERIES, **history.QUERIES, **exchange.QUERIES}
SQL = {**patterns.SQL, **functions.SQL, **reasoning.SQL, **history.SQL, **exchange.SQL}
