"""URL functions as Catalyst expressions.

The splitting follows RFC 3986 with the leniency of common URL parsers: control
characters are dropped, the authority keeps port and user, parameters of the last
path segment go, broken escapes stay.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def cleaned(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def netloc(url: Column) -> Column:
    """Lower-case authority with port and user; '' if there is none or its brackets do not match; null for null."""
    n = F.lower(F.regexp_extract(cleaned(url), _SCHEME + r"([^/?#]*)", 1))
    return F.when(n.contains("[") != n.contains("]"), F.lit("")).otherwise(n)


def path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(cleaned(url), _SCHEME + r"[^/?#]*([^?#]*)", 1), r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(cleaned(url), r"^[^?#]*\?([^#]*)", 1)


def unquote_plus(c: Column) -> Column:
    """Percent and plus decoding; broken escapes stay, invalid UTF-8 becomes U+FFFD."""
    return F.url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))


def parameters(url: Column) -> Column:
    """array<struct<k,v>> of a URL's query in order; pairs without '=' or with a blank value are left out."""
    parts = F.filter(F.split(query(url), "&"), lambda p: p.rlike(r"(?s)^[^=]*=."))
    return F.transform(
        parts,
        lambda p: F.struct(
            unquote_plus(F.substring_index(p, "=", 1)).alias("k"),
            unquote_plus(F.substr(p, F.instr(p, "=") + 1)).alias("v"),
        ),
    )


def host(value: Column) -> Column:
    """Authority of an address or of a bare host."""
    return netloc(F.when(value.contains("://"), value).otherwise(F.concat(F.lit("https://"), value)))


def root_domain(h: Column) -> Column:
    """The last two labels of a host, or the host itself if it has fewer."""
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    return F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(h)
