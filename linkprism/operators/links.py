"""From pages to prompt links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkprism.functions import urls
from linkprism.functions.binding import let
from linkprism.functions.text import squeeze, strip, unescape_all


def _first_filled(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cs], F.lit(""))


def link_target(link: Column) -> Column:
    """First of url, path, href that is an absolute web address after trimming, else ''."""
    tries = [strip(link[k]) for k in ("url", "path", "href")]
    return F.coalesce(*[F.when(t.rlike("^https?://"), t) for t in tries], F.lit(""))


def anchor_text(link: Column) -> Column:
    """First of text, anchor, alt that is not blank, trimmed, else ''."""
    return _first_filled(link["text"], link["anchor"], link["alt"])


def exploded_links(pages: DataFrame, keep: list[str]) -> DataFrame:
    """One row per link of each page, with its place from 1; pages with null or empty lists give none, null entries are left out."""
    return (
        pages.select(*keep, F.posexplode("links").alias("_p", "_l"))
        .where(F.col("_l").isNotNull())
        .select(*keep, (F.col("_p") + 1).alias("link_pos"), link_target(F.col("_l")).alias("target_url"), anchor_text(F.col("_l")).alias("anchor_text"), F.coalesce(F.col("_l.path"), F.lit("")).alias("link_path"))
    )


def may_have_prompt(url: Column) -> Column:
    """Cheap substring test before any parsing."""
    low = F.lower(url)
    plain = F.lit(False)
    for k in ("?q=", "&q=", "?prompt=", "&prompt="):
        plain = plain | low.contains(k)
    grok = low.contains("//x.com/i/grok") | low.contains("//www.x.com/i/grok")
    return plain | ((low.contains("?text=") | low.contains("&text=")) & grok)


def collected_parameters(df: DataFrame, url: str) -> DataFrame:
    """Adds ``prompt_parameters`` as collected: keys in lower case, q and prompt always, text on the grok path of x.com.

    Values are decoded once, unescaped and squeezed; blanks are dropped; of keys that
    differ in case the last one counts. Null and unparsable addresses give an empty map.
    """
    c = F.col(url)
    empty = F.array().cast("array<struct<k:string,v:string>>")
    grok = urls.netloc(c).isin("x.com", "www.x.com") & F.lower(urls.path(c)).startswith("/i/grok")
    wanted = let(grok, lambda g: F.filter(urls.parameters(c), lambda x: F.lower(x["k"]).isin("q", "prompt") | ((F.lower(x["k"]) == "text") & g)))
    asked = df.withColumn("__lp_kv", F.when(may_have_prompt(c), wanted).otherwise(empty))
    plain = asked.withColumn("__lp_v", unescape_all(F.transform("__lp_kv", lambda x: x["v"])))
    pairs = F.zip_with("__lp_kv", "__lp_v", lambda a, b: F.struct(a["k"].alias("k"), squeeze(b).alias("v")))

    def by_key(kv: Column) -> Column:
        """Values by exact key, of keys equal in lower case those of the last."""

        def entries(names: Column) -> Column:
            last = F.filter(names, lambda k: k == F.element_at(F.filter(names, lambda j: F.lower(j) == F.lower(k)), -1))
            return F.map_from_entries(F.transform(last, lambda k: F.struct(F.lower(k), F.transform(F.filter(kv, lambda x: x["k"] == k), lambda x: x["v"]))))

        return let(F.array_distinct(F.transform(kv, lambda x: x["k"])), entries)

    found = let(F.filter(pairs, lambda x: x["v"] != ""), by_key)
    return plain.withColumn("prompt_parameters", F.coalesce(found, F.create_map().cast("map<string,array<string>>"))).drop("__lp_kv", "__lp_v")


def prompt_links(pages: DataFrame, crawl: str, wat_file: str = "") -> DataFrame:
    """Links with a prompt parameter, in the collected schema."""
    links = exploded_links(pages, ["source_url"]).where(F.col("target_url") != "")
    found = collected_parameters(links.where(may_have_prompt(F.col("target_url"))), "target_url").where(F.size("prompt_parameters") > 0)
    return found.select(F.lit(crawl).alias("crawl"), F.lit(wat_file).alias("wat_file"), "source_url", "target_url", "anchor_text", "link_path", "prompt_parameters")


def page_totals(pages: DataFrame) -> DataFrame:
    """One row: pages, pages with links, links, links with an address, bytes of the addresses."""
    found = F.transform(F.filter("links", lambda x: x.isNotNull()), lambda x: F.octet_length(link_target(x)))
    each = pages.select(F.size(F.coalesce("links", F.array())).alias("n"), F.coalesce(found, F.array().cast("array<int>")).alias("b"))
    return each.agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("n") > 0).alias("n_pages_with_links"), F.coalesce(F.sum(F.size("b").cast("long")), F.lit(0)).alias("n_links"),
        F.coalesce(F.sum(F.size(F.filter("b", lambda x: x > 0)).cast("long")), F.lit(0)).alias("n_addresses"), F.coalesce(F.sum(F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("n_address_bytes"),
    )
