"""Exact per-key quantiles without gathering the values of a hot key (problem 2).

Method: distributed exact selection. Values become unsigned ordinals; each round
counts a histogram of the next ``bits`` bits per key, finds for every wanted rank
the bin that holds it, and keeps only the values of those bins for the next round, until
one value is left. All counts are sums, so partial aggregation merges a hot key's rows
on the map side and no task ever holds more than ``2**bits`` rows of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkprism.runtime import staged

_WS = r"^[\s\p{Z}\x{85}\x{1c}-\x{1f}]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}]+$"


def clean_key(c: Column | str) -> Column:
    """Trimmed, lower-case key; blank becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.regexp_replace(c, _WS, "")), F.lit(""))


def key_values(df: DataFrame, key_fields: list[str], value: Column) -> DataFrame:
    """One row (key_field, key_value, value) per row and key field; null keys are left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key_field"), clean_key(k).alias("key_value")) for k in key_fields])
    return (
        df.select(value.cast("long").alias("value"), F.explode(pairs).alias("k"))
        .select("k.key_field", "k.key_value", "value")
        .where(F.col("key_value").isNotNull())
    )


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], bits: int = 8) -> DataFrame:
    """Exact quantiles of the integer column ``value`` for every key.

    Returns the keys, ``n_rows`` (all rows of the key), ``n_values`` (rows with a
    value) and ``quantiles`` (array, one entry per probability). The quantile at p is
    the smallest value v with at least ceil(p * n_values) values <= v, at least the
    first. Null values count in ``n_rows`` only; a key without values has null
    quantiles. An empty input gives no rows. Ties and repeated rows just count.
    """
    # Mergeable full-resolution counts, split over (key, value): a hot key is spread over its values.
    counts = staged(df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "counts")
    lo, hi = counts.agg(F.min("_v"), F.max("_v")).first()
    per_key = counts.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_values")
    )
    if lo is None:
        return per_key.withColumn("quantiles", F.lit(None).cast("array<bigint>"))
    span = int(hi) - int(lo)
    width = max(bits, -(-max(span.bit_length(), 1) // bits) * bits)
    live = counts.where(F.col("_v").isNotNull()).withColumn("_o", F.col("_v") - F.lit(int(lo)))
    # One row per key and wanted rank: rank still to find inside the current prefix.
    wanted = per_key.where("n_values > 0").select(
        *keys,
        F.posexplode(
            F.array(*[F.greatest(F.lit(1), F.ceil(F.round(F.lit(float(p)) * F.col("n_values"), 9))).cast("long") for p in probs])
        ).alias("_i", "_rank"),
        F.lit(0).cast("long").alias("_prefix"),
    )
    names = {k: f"_k{j}" for j, k in enumerate(keys)}

    def same(extra: Column) -> Column:
        for k, other in names.items():
            extra = extra & F.col(k).eqNullSafe(F.col(other))
        return extra

    shift = width
    while shift > 0:
        inside = live.withColumn("_p", F.shiftright("_o", shift))
        if shift < width:  # at first all values are inside the one open prefix
            open_ = wanted.select(*[F.col(k).alias(n) for k, n in names.items()], "_prefix").distinct()
            inside = inside.join(open_, same(F.col("_p") == F.col("_prefix")), "left_semi")
        shift -= bits
        bins = inside.groupBy(*keys, "_p", F.shiftright("_o", shift).alias("_bin")).agg(F.sum("_n").alias("_c"))
        upto = Window.partitionBy(*keys, "_p").orderBy("_bin")  # at most 2**bits rows a partition
        bins = bins.withColumn("_cum", F.sum("_c").over(upto)).withColumnsRenamed(names)
        hit = wanted.join(bins, same((F.col("_prefix") == F.col("_p")) & (F.col("_rank") <= F.col("_cum")) & (F.col("_rank") > F.col("_cum") - F.col("_c"))))
        wanted = staged(hit.select(*keys, "_i", (F.col("_rank") - (F.col("_cum") - F.col("_c"))).alias("_rank"), F.col("_bin").alias("_prefix")), "ranks")
    found = wanted.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_prefix"))), lambda x: x["_prefix"] + F.lit(int(lo))).alias("quantiles")
    )
    return per_key.join(found.withColumnsRenamed(names), same(F.lit(True)), "left").select(*keys, "n_rows", "n_values", "quantiles")


def key_report(df: DataFrame, key_fields: list[str], value: Column, probs: list[float]) -> DataFrame:
    """Per key: rows, share of all rows of the table (null keys included) and exact quantiles."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    per_key = exact_quantiles(key_values(df, key_fields, value), ["key_field", "key_value"], "value", probs)
    return per_key.crossJoin(F.broadcast(total)).select(  # one row
        "key_field", "key_value", "n_rows", (F.col("n_rows") / F.col("_total")).alias("share"), "quantiles"
    )
