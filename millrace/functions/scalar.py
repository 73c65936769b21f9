"""Scalar functions of node columns. Expressions are Spark SQL text; these names are added to it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnFunction = Callable[..., Column]


def reverse_pair(a: Column, b: Column) -> Column:
    """Both texts reversed, one after the other; null counts as empty."""
    return F.concat(F.reverse(F.coalesce(a, F.lit(""))), F.reverse(F.coalesce(b, F.lit(""))))


def date_to_string(value: Column, pattern: str) -> Column:
    return F.date_format(value, pattern)


def to_long(value: Column) -> Column:
    return value.try_cast("bigint")


def sysdate() -> Column:
    """The time of the batch, not of the moment the plan was built."""
    return F.current_timestamp()


def capture(text: Column, pattern: str, group: int = 1, otherwise: Column | None = None) -> Column:
    """A group of the first match, or otherwise (null if not given)."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group)).otherwise(F.lit(None) if otherwise is None else otherwise)


class FunctionRegistry:
    """Named column functions. All arguments arrive as strings, as a class column's do."""

    def __init__(self) -> None:
        self._known: dict[str, ColumnFunction] = {}
        self.register("reverse", lambda *a: reverse_pair(*a) if len(a) == 2 else F.reverse(*a))
        self.register("concat", lambda *a: F.concat(*a))

    def register(self, name: str, build: ColumnFunction) -> None:
        """A function from columns to a column: stays in the JVM."""
        if name in self._known:
            raise ValueError(f"a column function named {name} exists")
        self._known[name] = build

    def register_python(self, name: str, function: Callable[..., object], returns: str = "string") -> None:
        """A Python function of strings, called on Arrow batches."""

        def batches(*columns: pd.Series) -> pd.Series:
            return pd.Series([function(*row) for row in zip(*columns)], dtype=object)

        batches.__annotations__ = {"columns": pd.Series, "return": pd.Series}
        self.register(name, F.pandas_udf(batches, returns))

    def call(self, name: str, *arguments: Column) -> Column:
        if name not in self._known:
            raise KeyError(f"no column function named {name}; known: {', '.join(sorted(self._known))}")
        return self._known[name](*(a.cast("string") for a in arguments))
