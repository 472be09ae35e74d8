"""Risk by linking site and by platform, ranking lookup and cross-crawl overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkprism.functions import urls
from linkprism.functions.text import counts_json, text_or_empty, top_items

# Columns of the tables, in order.
SOURCE_COLUMNS = [
    "crawl", "source_domain", "root_domain", "tranco_rank", "tranco_matched_domain", "tranco_bucket", "tranco_match_type", "rows", "share_of_risky_rows", "high_rows", "medium_rows",
    "unique_target_platforms", "target_platforms", "top_platform", "platform_features", "platform_distribution_json",
]
REVIEW_COLUMNS = ["crawl", "source_domain", "root_domain", "tranco_rank", "rows", "share_of_risky_rows", "high_rows", "medium_rows", "unique_target_platforms", "target_platforms", "platform_features"]
TARGET_COLUMNS = ["crawl", "target_platform", "rows", "share_of_risky_rows", "high_rows", "medium_rows", "unique_target_domains"]
# Popularity classes, most popular first.
BUCKETS = ["top_1k", "1k_10k", "10k_100k", "100k_1m", "unranked"]


def row_severity(df: DataFrame) -> Column:
    cs = [F.nullif(F.lower(text_or_empty(F.col(c))), F.lit("")) for c in ("tier2_severity", "severity") if c in df.columns]
    return F.coalesce(*cs, F.lit(""))


def row_labels(df: DataFrame) -> Column:
    """Upper-case labels from tier2_labels, prompt_labels or the ';' list in classification; blanks dropped."""
    tries = [F.col(c) for c in ("tier2_labels", "prompt_labels") if c in df.columns]
    if "classification" in df.columns:
        tries.append(F.split(F.col("classification"), ";"))
    raw = F.coalesce(*[F.when(F.size(t) > 0, t) for t in tries], F.array().cast("array<string>"))
    return F.filter(F.transform(raw, lambda x: F.upper(text_or_empty(x))), lambda x: x != "")


def risk_rows(df: DataFrame, order: Column) -> DataFrame:
    """(crawl, source_domain, target_platform, target_domain, severity, ord) with the fallbacks for missing fields; '' for no site."""
    have = set(df.columns)
    site = F.lower(text_or_empty(F.col("source_domain"))) if "source_domain" in have else F.lit("")
    if "source_url" in have:
        site = F.when(site == "", F.coalesce(urls.netloc(F.col("source_url")), F.lit(""))).otherwise(site)
    domain = F.lower(text_or_empty(F.col("target_domain"))) if "target_domain" in have else F.lit("")
    domain = F.when(domain == "", F.coalesce(urls.netloc(F.col("target_url")), F.lit(""))).otherwise(domain)
    platform = text_or_empty(F.col("target_platform")) if "target_platform" in have else F.lit("")
    return df.select(
        (text_or_empty(F.col("crawl")) if "crawl" in have else F.lit("")).alias("crawl"),
        site.alias("source_domain"),
        F.when(platform == "", F.lit("(unknown)")).otherwise(platform).alias("target_platform"),
        domain.alias("target_domain"),
        row_severity(df).alias("severity"),
        order.cast("long").alias("ord"),
    )


def _risky(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("severity").isin("medium", "high"))


def bucket(rank: Column) -> Column:
    """Popularity class of a rank; null and beyond a million are unranked."""
    return (
        F.when(rank.isNull(), F.lit("unranked")).when(rank <= 1_000, F.lit("top_1k")).when(rank <= 10_000, F.lit("1k_10k"))
        .when(rank <= 100_000, F.lit("10k_100k")).when(rank <= 1_000_000, F.lit("100k_1m")).otherwise(F.lit("unranked"))
    )


def bucket_order(df: DataFrame, bucket: str) -> DataFrame:
    """``df`` by popularity class."""
    return df.orderBy(F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col(bucket)))


def ranked(df: DataFrame, domain: str, ranking: DataFrame) -> DataFrame:
    """``df`` with tranco_rank, tranco_matched_domain, tranco_bucket, tranco_match_type of ``domain``.

    The domain itself is looked up first, then its parents of at least two labels. The
    lookup runs once per distinct domain; how the ranking (domain, rank) is joined is
    left to its size.
    """
    parts = F.split("__lp_root", r"\.")
    tries = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0))), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))
    asked = df.select(F.col(domain).alias("__lp_root")).where("__lp_root <> ''").distinct().select("__lp_root", F.posexplode(tries).alias("_pos", "_try"))
    hit = asked.join(ranking.select(F.col("domain").alias("_try"), "rank"), "_try")
    best = hit.groupBy("__lp_root").agg(F.min(F.struct("_pos", "rank", "_try")).alias("__lp_b"))
    joined = df.join(best, df[domain] == F.col("__lp_root"), "left")
    found = F.col("__lp_b").isNotNull()
    return joined.withColumns(
        {
            "tranco_rank": F.col("__lp_b.rank"),
            "tranco_matched_domain": F.coalesce("__lp_b._try", F.lit("")),
            "tranco_bucket": bucket(F.col("__lp_b.rank")),
            "tranco_match_type": F.when(~found, F.lit("not_ranked")).when(F.col("__lp_b._pos") == 0, F.lit("exact_root")).otherwise(F.lit("parent_match")),
        }
    ).drop("__lp_root", "__lp_b")


def _high_medium() -> list[Column]:
    return [F.count_if(F.col("severity") == "high").alias("high_rows"), F.count_if(F.col("severity") != "high").alias("medium_rows")]


def source_domain_risk(rows: DataFrame, ranking: DataFrame | None = None, by_crawl: bool = True) -> DataFrame:
    """One row per crawl and linking site over risky rows; sites without name are left out before counting.

    Ties among platforms go to the first seen (``ord``), then to the name.
    """
    keys = ["crawl"] if by_crawl else []
    risky = _risky(rows).where("source_domain <> ''")
    if not by_crawl:
        risky = risky.drop("crawl")
    per_platform = risky.groupBy(*keys, "source_domain", "target_platform").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("fo"), *_high_medium())
    packed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), F.col("fo").alias("b"), F.col("target_platform").alias("name"), "n")))
    sites = per_platform.groupBy(*keys, "source_domain").agg(
        F.sum("n").alias("rows"), F.sum("high_rows").alias("high_rows"), F.sum("medium_rows").alias("medium_rows"), F.count(F.lit(1)).alias("unique_target_platforms"), packed.alias("_r")
    )
    total = per_platform.groupBy(*keys).agg(F.sum("n").alias("_all"))  # one row per crawl
    sites = sites.join(F.broadcast(total), keys) if keys else sites.crossJoin(total).withColumn("crawl", F.lit(""))
    names = F.transform("_r", lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n")))
    out = sites.withColumns(
        {
            "share_of_risky_rows": F.bround(F.col("rows") / F.col("_all"), 6),
            "target_platforms": F.array_join(F.array_sort(F.transform("_r", lambda x: x["name"])), " | "),
            "top_platform": F.col("_r")[0]["name"],
            "platform_features": top_items(names),
            "platform_distribution_json": counts_json(names),
            "root_domain": urls.root_domain(urls.host(F.col("source_domain"))),
        }
    )
    if ranking is not None:
        out = ranked(out, "root_domain", ranking)
    else:
        out = out.withColumns({"tranco_rank": F.lit(None).cast("int"), "tranco_matched_domain": F.lit(""), "tranco_bucket": F.lit("unranked"), "tranco_match_type": F.lit("not_ranked")})
    return out.select(*SOURCE_COLUMNS)


def source_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("rows"), F.desc("unique_target_platforms"), F.asc("source_domain"))


def top_sources(risk: DataFrame, n: int = 200) -> DataFrame:
    return source_order(risk).limit(max(n, 1)).select(*REVIEW_COLUMNS)


def target_platform_risk(rows: DataFrame, by_crawl: bool = True) -> DataFrame:
    keys = ["crawl"] if by_crawl else []
    risky = _risky(rows) if by_crawl else _risky(rows).drop("crawl")
    # Distinct domains are merged in two steps, so that no platform's rows meet in one task.
    per_domain = risky.groupBy(*keys, "target_platform", "target_domain").agg(F.count(F.lit(1)).alias("n"), *_high_medium())
    out = per_domain.groupBy(*keys, "target_platform").agg(
        F.sum("n").alias("rows"), F.sum("high_rows").alias("high_rows"), F.sum("medium_rows").alias("medium_rows"), F.count_if(F.col("target_domain") != "").alias("unique_target_domains")
    )
    total = per_domain.groupBy(*keys).agg(F.sum("n").alias("_all"))
    out = out.join(F.broadcast(total), keys) if keys else out.crossJoin(total).withColumn("crawl", F.lit(""))
    return out.withColumn("share_of_risky_rows", F.bround(F.col("rows") / F.col("_all"), 6)).select(*TARGET_COLUMNS)


def target_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("rows"), F.asc("target_platform"))


def overview(rows: DataFrame, sources: bool, crawls: list[str] | None = None) -> DataFrame:
    """Per crawl: rows, risky rows, their share, severities and, for sources, distinct risky sites; a crawl of ``crawls`` without rows has zeros."""
    if crawls:
        return _with_missing(overview(rows, sources), crawls)
    risky = F.col("severity").isin("medium", "high")
    if sources:
        risky = risky & (F.col("source_domain") != "")
    aggs = [F.count(F.lit(1)).alias("rows_seen"), F.count_if(risky).alias("risky_rows"), F.count_if(risky & (F.col("severity") == "high")).alias("high_rows"), F.count_if(risky & (F.col("severity") == "medium")).alias("medium_rows")]
    out = rows.groupBy("crawl").agg(*aggs)
    share = F.coalesce(F.bround(F.try_divide("risky_rows", "rows_seen"), 6), F.lit(0.0)).alias("risky_share_of_all_rows")
    if not sources:
        return out.select("crawl", "rows_seen", "risky_rows", share, "high_rows", "medium_rows")
    sites = rows.where(risky).groupBy("crawl", "source_domain").agg(F.lit(1).alias("one")).groupBy("crawl").agg(F.count(F.lit(1)).alias("_u"))
    return out.join(sites, "crawl", "left").select("crawl", "rows_seen", "risky_rows", share, F.coalesce("_u", F.lit(0)).alias("unique_risky_source_domains"), "high_rows", "medium_rows")


def _with_missing(per_crawl: DataFrame, crawls: list[str]) -> DataFrame:
    names = per_crawl.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(crawls)], "crawl string")
    both = names.join(per_crawl, "crawl", "full")
    return both.select("crawl", *[F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in per_crawl.dtypes if c != "crawl"])


def detected_crawl(rows: DataFrame) -> DataFrame:
    """The first non-empty crawl name by ``ord``."""
    return rows.where("crawl <> ''").agg(F.min_by("crawl", "ord").alias("crawl"))


def distribution(df: DataFrame, key: str, total: Column | None = None) -> DataFrame:
    """(key, n_rows, share) by falling count, then key; an empty input gives no rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    whole = counts.agg(F.sum("n_rows").alias("_all"))  # one row
    return counts.crossJoin(whole).select(key, "n_rows", F.bround(F.col("n_rows") / F.col("_all"), 6).alias("share")).orderBy(F.desc("n_rows"), F.asc(key))


def stage_counts(df: DataFrame) -> DataFrame:
    """One row of counters of classified rows: seen, unmatched, benign, uncertain, with keywords, suspicious."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_seen"),
        F.count_if(F.col("target_platform").isNull()).alias("rows_unmatched"),
        F.count_if(F.col("target_platform").isNotNull() & ~F.col("is_suspicious")).alias("rows_benign"),
        F.count_if(F.col("target_platform").isNotNull() & F.col("is_suspicious")).alias("rows_suspicious"),
        F.count_if(F.col("target_platform").isNotNull() & F.col("has_ioc_keywords")).alias("rows_with_ioc_keywords"),
        F.count_if(F.col("classification_is_uncertain")).alias("rows_uncertain"),
    )


def stage_distributions(df: DataFrame) -> DataFrame:
    """(kind, name, n_rows) of matched rows: platforms, severities, labels, session and noise reasons, in one pass."""
    one = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("name"))
    parts = F.array(one("platform", "target_platform"), one("severity", "severity"), one("session", "session_entry_reason"), one("noise", "structural_noise_reason"))
    labels = F.transform("prompt_labels", lambda x: F.struct(F.lit("label").alias("kind"), x.alias("name")))
    each = df.where("target_platform is not null").select(F.explode(F.concat(parts, labels)).alias("e"))
    return each.where("e.name <> ''").groupBy("e.kind", "e.name").agg(F.count(F.lit(1)).alias("n_rows"))
