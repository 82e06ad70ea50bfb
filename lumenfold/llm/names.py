"""Names of columns: results replace columns of the input, and working columns meet none of them.

Spark compares names without regard to case, so this does too.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """The column of this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(columns: Iterable[str], results: Iterable[str]) -> list[str]:
    """The columns that no result replaces."""
    taken = {r.lower() for r in results}
    return [c for c in columns if c.lower() not in taken]


class Working:
    """Names for working columns: an attribute is its own name behind a prefix that no given column has."""

    def __init__(self, *columns: Iterable[str]):
        self._prefix = "__"
        while any(c.lower().startswith(self._prefix) for group in columns for c in group):
            self._prefix += "_"

    def __getattr__(self, name: str) -> str:
        return self._prefix + name
