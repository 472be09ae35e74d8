"""Queries of the text problems; SQL where the operator can be said in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkprism.llm import duplicates, language, lookalikes, mixing, mojibake, reading, tokenize, truncation
from linkprism.runtime import table

LINKS = "sample_classified_prompt_links"


def _prompt_keys(spark: SparkSession, sf: str) -> list[str]:
    """The query keys of all assistants: a rule table, one row per host."""
    return sorted({k for r in table(spark, sf, "platform_signatures").select("prompt_params").collect() for k in r[0] or ()})


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.cut_values(table(spark, sf, "sample_prompt_links"), keys=_prompt_keys(spark, sf)).select("link_no", "field_name")


def p1_source_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, sf, "sample_prompt_links"), keys=_prompt_keys(spark, sf))


def p1_limits(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.exposed_limits(table(spark, sf, "sample_prompt_links"), "source_domain", _prompt_keys(spark, sf))


def p3_segments(spark: SparkSession, sf: str) -> DataFrame:
    return language.relabelled(table(spark, sf, LINKS), table(spark, sf, "lang_samples"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_segments(spark, sf).where("is_case").select("row_id", "segment_no", "lang")


def p4_restored(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.garbled_records(table(spark, sf, LINKS), table(spark, sf, "demo_pages"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_restored(spark, sf).select("table_name", "record_id", "link_pos")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.disguised(table(spark, sf, LINKS), table(spark, sf, "known_prompts"))


def p5_texts(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, LINKS).select("row_id", "primary_prompt_text")
    return lookalikes.normalized(links, "primary_prompt_text", "row_id").select("row_id", "normalized_text")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.copies(table(spark, sf, LINKS))[1]


def p6_records(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.copies(table(spark, sf, LINKS))[0]


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.encoded(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


def p8_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and tokens per source, and how many texts decode to themselves."""
    docs = tokenize.encoded(table(spark, sf, "documents").select("doc_id", "source", "text"), "text")
    back = tokenize.decoded(docs, "ids")
    same = (F.coalesce("text", F.lit("")) == F.col("decoded_text")).cast("int")
    src = F.coalesce(F.lower(F.trim("source")), F.lit(""))
    return back.groupBy(src.alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"), F.sum(same).alias("n_same"))


def p8_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Every document by a deep tree of small leaves and by the usual one; whether their ids agree, per source."""
    docs = table(spark, sf, "documents").select(mixing.source_name(F.col("source")).alias("source"), "text")
    deep = tokenize.encoded(docs, "text", leaf=64).withColumnRenamed("ids", "deep")
    both = tokenize.encoded(deep, "text")
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.size("ids") > 0).alias("n_with_ids"), F.count_if(F.col("ids") == F.col("deep")).alias("n_equal"))


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(p9_mixture(spark, sf), table(spark, sf, "mix_targets"))


def p10_levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading.levels(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_levels(spark, sf).where("reading_level = 'demanding'").select("doc_id")


def p10_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per source and level; documents without a level under 'none'."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("_d"), mixing.source_name(F.col("source")).alias("source"))
    level = p10_levels(spark, sf).select("doc_id", F.coalesce("reading_level", F.lit("none")).alias("reading_level"))
    return docs.join(level, F.col("_d") == F.col("doc_id")).groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {
    "p1_found": p1_found,
    "p1_source_rates": p1_source_rates,
    "p1_limits": p1_limits,
    "p3_found": p3_found,
    "p3_segments": p3_segments,
    "p4_found": p4_found,
    "p4_restored": p4_restored,
    "p5_found": p5_found,
    "p5_texts": p5_texts,
    "p6_found": p6_found,
    "p6_records": p6_records,
    "p8_ids": p8_ids,
    "p8_round_trip": p8_round_trip,
    "p8_tree": p8_tree,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_levels": p10_levels,
    "p10_profile": p10_profile,
}

_IGNORED = r"'[\s\x0b\p{Z}\p{P}\x{85}\x1c-\x1f$+<=>^`|~]+', '', 'g'"
_FOLD = "replace(replace(lower(upper({0})), 'ß', 'ss'), 'ς', 'σ')"
_TEXT = f"regexp_replace({_FOLD.format('{0}')}, {_IGNORED})"
_VALUE = _TEXT.replace("{0}", "url_decode(replace(CASE WHEN contains(p, '=') THEN substr(p, instr(p, '=') + 1) ELSE '' END, '+', ' '))")
_PARAM = _FOLD.format("url_decode(replace(split_part(p, '=', 1), '+', ' '))") + " || '=' || " + _VALUE
_COPIES = f"""r AS (SELECT row_id, coalesce(crawl, '') AS crawl, {_TEXT.replace("{0}", "primary_prompt_text")} AS t, CASE WHEN contains(u, '?') THEN substr(u, 1, instr(u, '?') - 1) ELSE u END AS b,
       CASE WHEN contains(u, '?') THEN substr(u, instr(u, '?') + 1) ELSE '' END AS q
  FROM (SELECT *, coalesce(target_url, '') AS u FROM sample_classified_prompt_links WHERE regexp_matches(primary_prompt_text, '[^\\s\\x0b\\p{{Z}}\\x00-\\x1f\\x{{85}}\\x{{ad}}\\x{{200b}}-\\x{{200d}}\\x{{2060}}\\x{{feff}}]'))),
k AS (SELECT row_id, crawl, t, {_FOLD.format("url_decode(b)")} AS b, array_to_string(list_sort(list_transform(string_split(q, '&'), lambda p: {_PARAM})), '&') AS q FROM r),
g AS (SELECT row_id, min(row_id) OVER (PARTITION BY crawl, t, b, q) AS first_row_id FROM k)"""

ORACLE = {
    "p6_found": f"WITH {_COPIES} SELECT first_row_id, row_id FROM g WHERE row_id <> first_row_id",
    "p6_records": f"WITH {_COPIES} SELECT first_row_id, count(*) AS n_copies FROM g GROUP BY first_row_id",
}
