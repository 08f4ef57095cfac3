"""Every registered query of the library, with its SQL where SQL can express it."""

from __future__ import annotations

from ridgeline.plans import more_queries, queries as core

#: Both modules add to the same tables when they are imported.
MODULES = (core, more_queries)


def queries() -> dict:
    return dict(core.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(core.SQL)
