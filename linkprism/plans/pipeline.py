"""The stages as functions of DataFrames, and a run over files that writes each stage's outputs."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkprism.functions import urls
from linkprism.functions.text import rate_text, strip
from linkprism.operators import links, risk, rules
from linkprism.runtime import staged
from linkprism.sources import files, sinks

#: The crawls compared where none are named.
DEFAULT_RUNS = ["CC-MAIN-2025-51", "CC-MAIN-2026-04", "CC-MAIN-2026-08", "CC-MAIN-2026-12"]


def platform_filter(lines: DataFrame, signatures=rules.SIGNATURES, strict_prefilter: bool = True) -> DataFrame:
    """Lines of matched platforms, unchanged, with ``target_platform``; the substring test comes first."""
    kept = lines.where(rules.prefilter(F.col("value"), signatures)) if strict_prefilter else lines
    url = F.when(files.is_object(F.col("value")), F.get_json_object("value", "$.target_url"))
    return rules.matched(kept.withColumn("target_url", url), "target_url", signatures).where("target_platform is not null").select("value", "target_platform")


def enrich(rows: DataFrame, signatures=rules.SIGNATURES, label: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Prompt links with platform, prompt, session, noise, keyword and label columns.

    Unmatched rows keep a null platform. ``label`` replaces the rule classifier. The
    site is taken from ``source_url`` where ``source_domain`` is missing.
    """
    df = rows.withColumn("target_url", strip(F.col("target_url")))
    site = F.coalesce(urls.netloc(F.col("source_url")), F.lit(""))
    df = df.withColumn("source_domain", F.coalesce(F.nullif(F.lower(strip(F.col("source_domain"))), F.lit("")), site) if "source_domain" in df.columns else site)
    df = rules.prompt_parameters(rules.matched(df.drop("target_platform", "target_domain"), "target_url", signatures), "target_url", signatures)
    params = F.col("prompt_parameters")
    df = df.withColumns({"decoded_prompt_candidates": rules.flattened(params), "primary_prompt_text": rules.primary_prompt(params), "has_prompt_parameters": F.size(params) > 0})
    h, p = F.col("target_domain"), F.col("target_path")
    has_prompt = F.exists(urls.parameters(F.col("target_url")), lambda x: x["k"].isin(*rules.PROMPT_KEYS))
    df = df.withColumn("structural_noise_reason", rules.noise_code(h, p, has_prompt)).withColumns(rules.ioc_columns(params))
    df = df.withColumn("session_entry_reason", F.coalesce(rules.session_code(h, p, F.col("structural_noise_reason"), F.col("target_platform"), params), F.lit("")))
    df = df.withColumns({"structural_noise_reason": F.coalesce("structural_noise_reason", F.lit("")), "is_session_entry": F.col("session_entry_reason") != ""})
    done = label(df) if label else rules.classified(df, rules.rule_labels(F.col("primary_prompt_text")))
    return done.drop("signature", "target_path")


def written(enriched: DataFrame, include_benign: bool = False) -> DataFrame:
    kept = enriched.where("target_platform is not null")
    return kept if include_benign else kept.where("is_suspicious")


def run(spark: SparkSession, pages_path: str, run_root: str, crawl: str | None = None, *, ranking: DataFrame | None = None, include_benign: bool = True, top_n: int = 200, overwrite: bool = False, signatures=rules.SIGNATURES) -> dict:
    """All stages for one crawl: collect, filter, classify, source and target risk; returns the counters.

    Without a name the crawl is called after the input file.
    """
    began = time.time()
    sinks.guard(spark, run_root, overwrite=overwrite)
    pages = files.pages(spark, pages_path)
    collected = staged(links.prompt_links(pages, crawl or "", os.path.basename(pages_path)), "collected")
    sinks.json_lines(collected, f"{run_root}/00_collect/prompt_links")
    as_lines = collected.select(F.to_json(F.struct("*")).alias("value"))
    sinks.lines(platform_filter(as_lines, signatures), f"{run_root}/01_filter/prompt_links")
    enriched = staged(enrich(collected, signatures), "enriched")
    sinks.json_lines(written(enriched, include_benign), f"{run_root}/02_classify/classified_prompt_links")
    rows = risk.risk_rows(written(enriched, include_benign), F.monotonically_increasing_id())
    crawl = crawl_name(crawl, rows, pages_path)
    rows = rows.withColumn("crawl", F.lit(crawl))
    sources, targets = risk.source_domain_risk(rows, ranking), risk.target_platform_risk(rows)
    sinks.csv(risk.source_order(sources), f"{run_root}/03_source/tables/source_domain_risk", risk.SOURCE_COLUMNS)
    sinks.csv(risk.top_sources(sources, top_n), f"{run_root}/03_source/review/top_source_domains", risk.REVIEW_COLUMNS)
    sinks.csv(risk.target_order(targets), f"{run_root}/03_target/tables/target_platform_risk", risk.TARGET_COLUMNS)
    for kind in ("source", "target"):
        got = risk.overview(rows, kind == "source").collect()  # one row per crawl
        sinks.json_file(spark, {"crawl": crawl, "generated_at_epoch": int(time.time()), **(got[0].asDict() if got else {"rows_seen": 0})}, f"{run_root}/03_{kind}/summary.json")
        sinks.json_file(spark, sinks.manifest(spark, f"{kind}_risk", crawl, pages_path, f"{run_root}/03_{kind}"), f"{run_root}/03_{kind}/manifest.json")
    counts = risk.stage_counts(enriched).first().asDict()
    took = spark.range(1).select(rate_text(F.lit(counts["rows_seen"]), F.lit(time.time() - began)).alias("r")).first()["r"]
    spread = [r.asDict() for r in risk.stage_distributions(enriched).orderBy("kind", F.desc("n_rows"), "name").collect()]  # as many as there are codes
    summary = counts | links.page_totals(pages).first().asDict() | {"rate": took}
    sinks.json_file(spark, summary | {"distributions": spread}, f"{run_root}/summary.json")
    return summary


def crawl_name(given: str | None, rows: DataFrame, path: str) -> str:
    """The name given, else the first one in the rows, else the file's stem."""
    if given:
        return given
    found = risk.detected_crawl(rows).first()
    return (found and found["crawl"]) or os.path.basename(path.rstrip("/")).split(".")[0]


def run_specs(run_roots: list[str], names: list[str] | None = None, runs_base: str = "runs") -> list[tuple[str, str]]:
    """(crawl, root) pairs; given names must match the roots in number, missing ones are the folders' names.

    Without roots the default crawls are taken, each from its folder under ``runs_base``.
    """
    if not run_roots:
        if names:
            raise ValueError("crawl names need run roots")
        return [(c, f"{runs_base}/collect_{c.lower().replace('cc-main-', 'ccmain').replace('-', '_')}") for c in DEFAULT_RUNS]
    if names and len(names) != len(run_roots):
        raise ValueError("as many crawl names as run roots are needed")
    return [(n, r) for n, r in zip(names or [os.path.basename(r.rstrip("/")) for r in run_roots], run_roots)]


def cross_crawl(frames: dict[str, DataFrame], ranking: DataFrame | None = None) -> dict[str, DataFrame]:
    """``all_crawls`` from classified rows per crawl, whose given name goes before the rows' own."""
    rows = None
    for name, df in frames.items():
        part = risk.risk_rows(df, F.monotonically_increasing_id()).withColumn("crawl", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return all_crawls(rows, list(frames), ranking)


def all_crawls(rows: DataFrame, crawls: list[str], ranking: DataFrame | None = None) -> dict[str, DataFrame]:
    """Source and target risk of all crawls and their overviews from the rows of ``risk_rows``; a crawl without rows has zeros."""
    order = lambda df, name: df.orderBy("crawl", F.desc("rows"), name)
    return {
        "source_domain_risk_all_crawls": order(risk.source_domain_risk(rows, ranking), "source_domain"),
        "target_platform_risk_all_crawls": order(risk.target_platform_risk(rows), "target_platform"),
        "source_overview_by_crawl": risk.overview(rows, True, crawls),
        "target_overview_by_crawl": risk.overview(rows, False, crawls),
    }
