"""The operators bound to the tables, with the same results in SQL."""

from __future__ import annotations


def registered():
    """(name, query, SQL or None) of every query."""
    from . import ingest, live, navigation, pages, search

    for module in (search, navigation, pages, ingest, live):
        for f in module.QUERIES:
            yield f.__name__, f, getattr(f, "sql", None)
