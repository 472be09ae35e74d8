"""Helpers of the text operators: bounded training samples and blank tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_BLANK = r"[^\s\p{Z}\x{0}-\x{1f}\x{85}\x{ad}\x{200b}-\x{200d}\x{2060}\x{feff}]"


def is_text(c: Column) -> Column:
    """True if the value is neither null, empty nor only white space."""
    return c.isNotNull() & c.rlike(NOT_BLANK)


def bounded_sample(df: DataFrame, keys: list[str], bound: int) -> DataFrame:
    """About ``bound`` rows, never more, chosen by a hash of ``keys`` so that the choice does not depend on order.

    Only for fitting models: the bound is a documented parameter of the caller. One
    count sets the share to keep; only the kept rows travel.
    """
    total = df.count()
    share = 1.0 if total <= bound else 0.95 * bound / total
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(bound)
