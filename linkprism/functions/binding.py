"""Evaluate an expression once and use it many times inside another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row.

    A column that occurs many times in an expression is copied by the optimizer wherever
    projections merge or filters move; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
