"""Queries of the general problems (2 and 7) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkprism.operators.hotkeys import key_report
from linkprism.operators.snapshots import snapshot_changes
from linkprism.runtime import table

KEY_FIELDS = ["source_domain", "target_platform"]
PROBS = [0.25, 0.5, 0.75, 0.95]
HOT_SHARE = 0.04


def _report(spark: SparkSession, sf: str) -> DataFrame:
    return key_report(table(spark, sf, "sample_classified_prompt_links"), KEY_FIELDS, F.length("target_url"), PROBS)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).where(F.col("share") >= HOT_SHARE).select("key_field", "key_value")


def p2_key_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    q = [F.col("quantiles")[i].alias(f"url_length_p{round(p * 100)}") for i, p in enumerate(PROBS)]
    return _report(spark, sf).select("key_field", "key_value", "n_rows", "share", *q)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "sample_classified_prompt_links")
    return snapshot_changes(links, table(spark, sf, "crawl_runs"), "crawl", "link_id", ["loaded_at", "row_id"], ["source_domain", "target_url"])


def p7_change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return p7_found(spark, sf).groupBy("crawl", "change_kind").agg(F.count(F.lit(1)).alias("n_links"))


QUERIES = {"p2_found": p2_found, "p2_key_quantiles": p2_key_quantiles, "p7_found": p7_found, "p7_change_counts": p7_change_counts}

_KEYS = """
keyed AS (
  SELECT 'source_domain' AS key_field, lower(regexp_replace(source_domain, '^[\\s\\x{a0}\\x{3000}]+|[\\s\\x{a0}\\x{3000}]+$', '', 'g')) AS key_value, length(target_url) AS v FROM sample_classified_prompt_links
  UNION ALL
  SELECT 'target_platform', lower(regexp_replace(target_platform, '^[\\s\\x{a0}\\x{3000}]+|[\\s\\x{a0}\\x{3000}]+$', '', 'g')), length(target_url) FROM sample_classified_prompt_links),
total AS (SELECT count(*) AS n FROM sample_classified_prompt_links)"""

_STATES = """
ranked AS (
  SELECT l.crawl, r.seq, l.link_id, l.source_domain, l.target_url,
         row_number() OVER (PARTITION BY l.crawl, l.link_id ORDER BY l.loaded_at DESC, l.row_id DESC) AS k
  FROM sample_classified_prompt_links l JOIN crawl_runs r ON r.crawl = l.crawl),
state AS (SELECT * FROM ranked WHERE k = 1),
changes AS (
  SELECT r.crawl, coalesce(a.link_id, b.link_id) AS link_id,
         CASE WHEN a.link_id IS NULL THEN 'added' WHEN b.link_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM (SELECT *, seq + 1 AS next FROM state) a
  FULL OUTER JOIN state b ON a.next = b.seq AND a.link_id = b.link_id
  JOIN crawl_runs r ON r.seq = coalesce(b.seq, a.next)
  WHERE r.seq > 1 AND (a.link_id IS NULL OR b.link_id IS NULL
     OR a.source_domain IS DISTINCT FROM b.source_domain OR a.target_url IS DISTINCT FROM b.target_url))"""

ORACLE = {
    "p2_found": f"WITH {_KEYS} SELECT key_field, key_value FROM keyed WHERE key_value <> '' GROUP BY ALL HAVING count(*) >= 0.04 * (SELECT n FROM total)",
    "p2_key_quantiles": f"""WITH {_KEYS},
o AS (SELECT *, row_number() OVER (PARTITION BY key_field, key_value ORDER BY v) AS i, count(v) OVER (PARTITION BY key_field, key_value) AS n FROM keyed WHERE key_value <> '')
SELECT key_field, key_value, count(*) AS n_rows, count(*)::DOUBLE / (SELECT n FROM total) AS share,
       {", ".join(f"max(CASE WHEN i = greatest(1, ceil(round({p} * n, 9))) THEN v END) AS url_length_p{round(p * 100)}" for p in PROBS)}
FROM o GROUP BY key_field, key_value""",
    "p7_found": f"WITH {_STATES} SELECT crawl, link_id, change_kind FROM changes",
    "p7_change_counts": f"WITH {_STATES} SELECT crawl, change_kind, count(*) AS n_links FROM changes GROUP BY crawl, change_kind",
}
