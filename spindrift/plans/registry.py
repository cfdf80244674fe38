"""Registry of core queries: a Spark callable, the operators it covers and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under ``name``."""

    def put(f):
        QUERIES[name], COVERS[name] = f, covers
        if sql:
            ORACLES[name] = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql.strip())  # short lambdas in the older form
        return f

    return put
