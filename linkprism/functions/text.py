"""Text functions; only HTML entities need Python."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkprism.functions.binding import let
from linkprism.functions.urls import unquote_plus

_SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]+"


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, ends trimmed; NUL counts as a space."""
    return F.trim(F.regexp_replace(F.replace(c, F.lit("\x00"), F.lit(" ")), _SPACE, " "))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}\x{85}\x{1c}-\x{1f}]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}]+$", "")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([None if v is None else [None if x is None else html.unescape(x) for x in v] for v in s], dtype=object)


def unescape_all(c: Column) -> Column:
    """HTML entities of an array of texts; values without '&' skip Python (they reach it as null)."""
    has = F.exists(c, lambda x: x.contains("&"))
    return F.when(has, _unescape(F.when(has, c))).otherwise(c)


def decode_to_fixpoint(c: Column) -> Column:
    """Up to three rounds of percent decoding; further rounds at a fixpoint change nothing."""
    return unquote_plus(unquote_plus(unquote_plus(c)))


def keywords_in(text: Column, keywords: list[str]) -> Column:
    """The keywords that occur in the lower-case text, in list order."""
    return let(F.lower(text), lambda low: F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(low, k)))


def top_items(ranked: Column, n: int = 3) -> Column:
    """'name:count | ...' of the first n entries of a ranked array<struct<name,n>>."""
    return F.array_join(F.transform(F.slice(ranked, 1, n), lambda x: F.concat(x["name"], F.lit(":"), x["n"].cast("string"))), " | ")


def counts_json(ranked: Column) -> Column:
    """JSON object with sorted keys, ', ' and ': ' as separators."""
    quoted = lambda s: F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    entry = lambda x: F.concat(quoted(x["name"]), F.lit(": "), x["n"].cast("string"))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(ranked), entry), ", "), F.lit("}"))


def size_text(n: Column) -> Column:
    """Bytes with a unit, steps of 1024."""
    out = F.concat(F.format_number(n.cast("double"), 0), F.lit(" B"))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        out = F.when(n >= 1024**i, F.concat(F.format_string("%.1f", n / float(1024**i)), F.lit(f" {unit}"))).otherwise(out)
    return out


def rate_text(rows: Column, seconds: Column) -> Column:
    """Rows a second, thousands as K."""
    r = rows / F.greatest(seconds.cast("double"), F.lit(1e-9))
    return F.when(r >= 1000, F.concat(F.format_string("%.1f", r / 1000), F.lit("K rows/s"))).otherwise(F.concat(F.format_string("%.0f", r), F.lit(" rows/s")))
