"""Column names that no table in sight has."""

from __future__ import annotations

from collections.abc import Iterable


def free_prefix(*columns: Iterable[str]) -> str:
    """Underscores that no column begins with."""
    taken = {c.lower() for some in columns for c in some}
    prefix = "_"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix
