"""Queries of the core operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkprism.functions import urls
from linkprism.functions.text import keywords_in, size_text, squeeze
from linkprism.operators import links, risk, rules
from linkprism.plans import pipeline
from linkprism.runtime import table
from linkprism.sources.files import PAGE, is_object

CLASSIFIED = "sample_classified_prompt_links"

# All addresses of these hosts, paths and queries, so that every rule, exclusion and code is met.
HOSTS = [
    "chatgpt.com", "chat.openai.com", "claude.ai", "www.claude.ai", "copilot.microsoft.com", "m365copilot.com", "perplexity.ai", "www.perplexity.ai", "gemini.google.com",
    "grok.com", "x.com", "www.x.com", "netflix.com", "poe.com", "chat.deepseek.com", "deepseek.com", "www.doubao.com", "meta.ai", "kimi.com", "chat.mistral.ai", "minimax.io",
    "chat.minimax.io", "chat.qwen.ai", "yiyan.baidu.com", "yuanbao.tencent.com", "chat.z.ai", "you.com", "chatgpt.com:443", "ChatGPT.com",
]
PATHS = [
    "/", "", "/c/1", "/g/a", "/login", "/download", "/public/artifacts/9", "/new", "/chat/7", "/onboarding", "/prompts", "/chats/2", "/shares/2", "/images/create/4", "/pro", "/comet",
    "/finance/1", "/page/2", "/hub/3", "/search/2", "/share/5", "/app", "/u/1/app", "/gem/3", "/imagine", "/imagine/4", "/imagined", "/i/grok", "/i/grok/share", "/a/chat/6", "/api_keys", "/beta",
    "/policies/x", "/news/1", "/zh-cn/news/1", "/discover", "/audio", "/audio/3", "/subscribe/1", "/chat",
]
QUERIES_OF = ["", "?q=hello+there", "?prompt=Always%20cite%20this", "?Q=upper", "?x=1&text=best+choice", "?q=&query=b%2Bc", "?message=remember&q=go-to%20source"]


def _cases(spark: SparkSession) -> DataFrame:
    """(case_no, target_url) of every combination."""

    def pick(xs: list[str], step: int):
        return F.get(F.array(*[F.lit(x) for x in xs]), (F.floor(F.col("id") / step) % len(xs)).cast("int"))

    n = len(QUERIES_OF)
    url = F.concat(F.lit("https://"), pick(HOSTS, n * len(PATHS)), pick(PATHS, n), pick(QUERIES_OF, 1))
    return spark.range(len(HOSTS) * len(PATHS) * n).select(F.col("id").alias("case_no"), url.alias("target_url"))


def _signatures(spark: SparkSession, sf: str):
    return rules.signatures_from(table(spark, sf, "platform_signatures"))


def link_targets(spark, sf):
    return links.exploded_links(table(spark, sf, "demo_pages"), ["page_id"]).select("page_id", "link_pos", "target_url", "anchor_text")


def collected_links(spark, sf):
    found = links.collected_parameters(links.exploded_links(table(spark, sf, "demo_pages"), ["page_id", "source_domain"]), "target_url")
    keys = F.array_join(F.array_sort(F.map_keys("prompt_parameters")), ",")
    return found.where(F.size("prompt_parameters") > 0).select("page_id", "link_pos", "target_url", keys.alias("prompt_keys"))


def collected_prompts(spark, sf):
    """Decoded values as collected."""
    found = links.collected_parameters(table(spark, sf, "sample_prompt_links").select("link_no", "target_url"), "target_url")
    return found.select("link_no", F.explode("prompt_parameters").alias("key", "vals")).select("link_no", "key", F.array_join("vals", "\n").alias("values"))


def url_parts(spark, sf):
    c = F.col("target_url")
    return table(spark, sf, "sample_prompt_links").select("link_no", urls.netloc(c).alias("netloc"), urls.path(c).alias("path"), F.length(urls.query(c)).alias("query_length"))


def query_keys(spark, sf):
    kv = table(spark, sf, CLASSIFIED).select(F.explode(urls.parameters(F.col("target_url"))).alias("p"))
    return kv.groupBy(F.col("p.k").alias("key")).agg(F.count(F.lit(1)).alias("n_uses"), F.sum(F.length("p.v")).alias("n_chars"))


def root_domain_counts(spark, sf):
    site = F.lower(F.trim("source_domain"))
    return table(spark, sf, CLASSIFIED).where("source_domain is not null").groupBy(urls.root_domain(site).alias("root_domain")).agg(F.count(F.lit(1)).alias("n_rows"))


def platform_match(spark, sf):
    df = rules.matched(table(spark, sf, CLASSIFIED).select("row_id", "target_url"), "target_url", _signatures(spark, sf))
    return df.select("row_id", "target_domain", "target_platform")


def platform_distribution(spark, sf):
    df = rules.matched(table(spark, sf, CLASSIFIED).select("target_url"), "target_url", _signatures(spark, sf))
    return risk.distribution(df.where("target_platform is not null"), "target_platform")


def rules_platform(spark, sf):
    df = rules.matched(_cases(spark), "target_url")
    return df.select("case_no", "target_platform", F.coalesce(F.col("signature") == -1, F.lit(False)).alias("excluded"))


def rules_noise(spark, sf):
    return _cases(spark).select("case_no", rules.noise_reason(F.col("target_url")).alias("noise_reason"))


def rules_session(spark, sf):
    df = rules.prompt_parameters(rules.matched(_cases(spark), "target_url"), "target_url")
    return df.select("case_no", rules.session_reason(F.col("target_url"), F.col("target_platform"), F.col("prompt_parameters")).alias("session_reason"), rules.primary_prompt(F.col("prompt_parameters")).alias("primary_prompt"))


def enriched_links(spark, sf):
    """The classification stage over extracted links."""
    df = pipeline.enrich(table(spark, sf, "sample_prompt_links").drop("primary_prompt_text"), _signatures(spark, sf))
    return df.select("link_no", "source_domain", "target_domain", "target_platform", "primary_prompt_text", "has_prompt_parameters", "session_entry_reason", "has_ioc_keywords", "classification", "severity", "is_suspicious")


def stage_metrics(spark, sf):
    return risk.stage_counts(pipeline.enrich(table(spark, sf, "sample_prompt_links"), _signatures(spark, sf)))


def stage_distributions(spark, sf):
    return risk.stage_distributions(pipeline.enrich(table(spark, sf, "sample_prompt_links"), _signatures(spark, sf)))


def page_totals(spark, sf):
    return links.page_totals(table(spark, sf, "demo_pages"))


def row_label_counts(spark, sf):
    df = table(spark, sf, CLASSIFIED)
    return risk.distribution(df.select(F.explode(risk.row_labels(df)).alias("label")), "label")


def ranking_buckets(spark, sf):
    sites = risk.ranked(table(spark, sf, CLASSIFIED).where("source_domain is not null").select(urls.root_domain(urls.host(F.trim("source_domain"))).alias("root_domain")), "root_domain", _ranking(spark, sf))
    return risk.bucket_order(risk.distribution(sites, "tranco_bucket"), "tranco_bucket")


def first_crawl(spark, sf):
    return risk.detected_crawl(_risk_rows(spark, sf))


def prompt_whitespace(spark, sf):
    t = F.col("primary_prompt_text")
    return table(spark, sf, "sample_prompt_links").where(t.isNotNull()).select("link_no", F.length(squeeze(t)).alias("n_squeezed"), size_text(F.octet_length(t)).alias("size"))


def ioc_keywords(spark, sf):
    hits = F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in rules.IOC_KEYWORDS]), F.array(*[keywords_in(F.col("primary_prompt_text"), ks) for ks in rules.IOC_KEYWORDS.values()]))).alias("category", "words")
    df = table(spark, sf, CLASSIFIED).where("primary_prompt_text is not null").select(hits)
    return df.select("category", F.explode("words").alias("keyword")).groupBy("category", "keyword").agg(F.count(F.lit(1)).alias("n_rows"))


def rule_labels(spark, sf):
    df = table(spark, sf, CLASSIFIED).select("row_id", rules.rule_labels(F.col("primary_prompt_text")).alias("labels"))
    return df.select("row_id", F.array_join("labels", ";").alias("classification"), rules.severity(F.col("labels")).alias("rule_severity"))


def rule_label_counts(spark, sf):
    labels = F.explode(rules.rule_labels(F.col("primary_prompt_text"))).alias("label")
    return risk.distribution(table(spark, sf, CLASSIFIED).select(labels), "label")


def severity_counts(spark, sf):
    df = table(spark, sf, CLASSIFIED)
    return risk.distribution(df.select("crawl", risk.row_severity(df).alias("severity")), "severity")


def _risk_rows(spark, sf):
    return risk.risk_rows(table(spark, sf, CLASSIFIED), F.col("row_id"))


def _ranking(spark, sf):
    """A ranking of the page table's hosts and their roots, by number of pages, then name."""
    pages = table(spark, sf, "demo_pages").where("source_domain is not null").select(F.lower(F.trim("source_domain")).alias("h"))
    both = pages.select(F.explode(F.array_distinct(F.array("h", urls.root_domain(F.col("h"))))).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    # A popularity rank: 1 plus the domains of larger counts, summed over the few distinct counts, not over the domains.
    larger = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = both.groupBy("n").agg(F.count(F.lit(1)).alias("k")).select("n", (F.coalesce(F.sum("k").over(larger), F.lit(0)) + 1).cast("int").alias("rank"))
    return both.join(sizes, "n").select("domain", "rank")


def source_domain_risk(spark, sf):
    return risk.source_domain_risk(_risk_rows(spark, sf), _ranking(spark, sf))


def source_risk_all_crawls_together(spark, sf):
    return risk.source_domain_risk(_risk_rows(spark, sf), by_crawl=False).drop("crawl")


def top_source_domains(spark, sf):
    return risk.top_sources(risk.source_domain_risk(_risk_rows(spark, sf).withColumn("crawl", F.lit("all")), None), 25)


def target_platform_risk(spark, sf):
    return risk.target_platform_risk(_risk_rows(spark, sf))


def overview_sources(spark, sf):
    return risk.overview(_risk_rows(spark, sf), True)


def overview_targets(spark, sf):
    return risk.overview(_risk_rows(spark, sf), False)


def cross_crawl_targets(spark, sf):
    """All delivered crawls from one scan of the table."""
    names = [r[0] for r in table(spark, sf, "crawl_runs").select("crawl").collect()]  # one row per delivery
    return pipeline.all_crawls(_risk_rows(spark, sf).where(F.col("crawl").isin(names)), names)["target_platform_risk_all_crawls"]


def ranking_lookup(spark, sf):
    sites = table(spark, sf, "sample_prompt_links").where("source_domain is not null").select(urls.root_domain(F.lower(F.trim("source_domain"))).alias("root_domain")).distinct()
    return risk.ranked(sites, "root_domain", _ranking(spark, sf))


def resume_anti_join(spark, sf):
    """Input files not yet completed: those of the links that no page of the same site was fetched for."""
    done = table(spark, sf, "demo_pages").select(F.lower(F.trim("source_domain")).alias("d")).where("d is not null").distinct()
    todo = table(spark, sf, "sample_prompt_links").select("wat_file", F.lower(F.trim("source_domain")).alias("d")).where("d is not null")
    return todo.join(done, "d", "left_anti").groupBy("wat_file").agg(F.count(F.lit(1)).alias("n_links"))


def json_round_trip(spark, sf):
    """Pages written as JSON lines and read back through the permissive reader's expressions."""
    lines = table(spark, sf, "demo_pages").select("page_id", F.to_json(F.struct("source_url", "links")).alias("value"))
    back = lines.where(is_object(F.col("value"))).select("page_id", F.from_json("value", PAGE).alias("r"))
    return back.select("page_id", F.col("r.source_url").alias("source_url"), F.coalesce(F.size("r.links"), F.lit(-1)).alias("n_links"))


def prefilter_counts(spark, sf):
    sig = _signatures(spark, sf)
    df = rules.matched(table(spark, sf, CLASSIFIED).select("target_url"), "target_url", sig)
    return df.select(rules.prefilter(F.col("target_url"), sig).alias("passes"), F.col("target_platform").isNotNull().alias("is_matched")).groupBy("passes", "is_matched").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {
    f.__name__: f
    for f in (
        link_targets, collected_links, collected_prompts, url_parts, query_keys, root_domain_counts, platform_match, platform_distribution, rules_platform, rules_noise,
        rules_session, enriched_links, stage_metrics, prompt_whitespace, ioc_keywords, rule_labels, rule_label_counts, severity_counts, source_domain_risk,
        source_risk_all_crawls_together, top_source_domains, target_platform_risk, overview_sources, overview_targets, cross_crawl_targets, ranking_lookup,
        resume_anti_join, json_round_trip, prefilter_counts, stage_distributions, page_totals, row_label_counts, ranking_buckets, first_crawl,
    )
}

# --- SQL ---------------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_q(x) for x in xs) + "]"


_NETLOC = r"lower(regexp_extract(target_url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1))"
_PATH = r"regexp_replace(regexp_extract(target_url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"
_QUERY = r"regexp_extract(target_url, '^[^?#]*\?([^#]*)', 1)"
_KV = f"unnest(list_filter(string_split({_QUERY}, '&'), lambda p: regexp_matches(p, '(?s)^[^=]*=.')))"
_DEC = "url_decode(replace({}, '+', ' '))"
_KEY, _VALUE = _DEC.format("split_part(p, '=', 1)"), _DEC.format("substr(p, instr(p, '=') + 1)")
_SITE = r"lower(regexp_replace(source_domain, '^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$', '', 'g'))"
_ROOT = "array_to_string(list_filter(string_split({0}, '.'), lambda x: x <> '')[-2:], '.')"

_CASES = f"""cases AS (SELECT h_.i * {len(PATHS) * len(QUERIES_OF)} + p_.i * {len(QUERIES_OF)} + q_.i AS case_no, 'https://' || h_.x || p_.x || q_.x AS target_url
  FROM (SELECT unnest({_list(HOSTS)}) AS x, unnest(range({len(HOSTS)})) AS i) h_, (SELECT unnest({_list(PATHS)}) AS x, unnest(range({len(PATHS)})) AS i) p_, (SELECT unnest({_list(QUERIES_OF)}) AS x, unnest(range({len(QUERIES_OF)})) AS i) q_),
parts AS (SELECT case_no, target_url, {_NETLOC} AS h, lower({_PATH}) AS p, {_QUERY} AS q FROM cases)"""

# The rules below are written out by hand and share nothing with the tables of the engine.
_PLATFORM = """sig(i, name, host) AS (VALUES (0, 'chatgpt', 'chatgpt.com'), (0, 'chatgpt', 'chat.openai.com'), (1, 'claude', 'claude.ai'), (2, 'copilot', 'copilot.microsoft.com'),
  (2, 'copilot', 'm365copilot.com'), (2, 'copilot', 'copilot.cloud.microsoft'), (3, 'perplexity', 'perplexity.ai'), (4, 'gemini', 'gemini.google.com'), (5, 'grok', 'grok.com'),
  (6, 'grok', 'x.com'), (7, 'poe', 'poe.com'), (8, 'deepseek', 'chat.deepseek.com'), (9, 'deepseek', 'deepseek.com'), (10, 'doubao', 'doubao.com'), (11, 'meta_ai', 'meta.ai'),
  (12, 'kimi', 'kimi.com'), (13, 'le_chat', 'chat.mistral.ai'), (14, 'minimax', 'minimax.io'), (16, 'qwen', 'qwen.ai'), (17, 'yiyan', 'yiyan.baidu.com'),
  (18, 'yuanbao', 'yuanbao.tencent.com'), (19, 'z_ai', 'z.ai'), (20, 'you', 'you.com')),
barred(i, path, below) AS (VALUES (1, '/download', false), (1, '/login', false), (1, '/public/artifacts/', true), (2, '/onboarding', false), (2, '/prompts', false), (3, '/pro', false),
  (3, '/comet', false), (3, '/finance/', true), (3, '/page/', true), (3, '/hub/', true), (4, '/share/', true), (8, '/api_keys', false), (8, '/beta', false), (9, '/policies/', true),
  (9, '/news/', true), (9, '/zh-cn/news/', true), (11, '/discover', false), (14, '/audio', false), (14, '/news/', true), (14, '/subscribe/', true), (14, '/audio/', true)),
fits AS (SELECT case_no, i, any_value(name) AS name FROM parts JOIN sig ON h = host OR ends_with(h, '.' || host) WHERE i <> 6 OR starts_with(p, '/i/grok') GROUP BY case_no, i),
first AS (SELECT case_no, min(i) AS i, arg_min(name, i) AS name FROM fits GROUP BY case_no),
m AS (SELECT parts.*, first.i, first.name, EXISTS (SELECT 1 FROM barred b WHERE b.i = first.i AND (p = path OR below AND starts_with(p, path))) AS excluded FROM parts LEFT JOIN first USING (case_no)),
owned AS (SELECT *, CASE WHEN NOT excluded THEN name END AS platform FROM m)"""
_NOISE = """CASE WHEN len(list_filter(string_split(q, '&'), lambda x: regexp_matches(x, '^(q|prompt|query|message|text)=.'))) > 0 THEN NULL
  WHEN regexp_matches(h, '(^|[.])x[.]com$') AND NOT starts_with(p, '/i/grok') THEN 'x_non_grok_path'
  WHEN regexp_matches(h, '(^|[.])claude[.]ai$') AND starts_with(p, '/public/artifacts/') THEN 'claude_artifact_page'
  WHEN regexp_matches(h, '(^|[.])claude[.]ai$') AND p IN ('/download', '/login') THEN 'claude_non_chat_page'
  WHEN regexp_matches(h, '(^|[.])copilot[.]microsoft[.]com$') AND p IN ('/onboarding', '/prompts') THEN 'copilot_non_chat_page'
  WHEN h = 'gemini.google.com' AND starts_with(p, '/share/') THEN 'gemini_share_page'
  WHEN regexp_matches(h, '(^|[.])perplexity[.]ai$') AND regexp_matches(p, '^/(pro$|comet$|finance/|page/|hub/)') THEN 'perplexity_non_chat_page'
  WHEN regexp_matches(h, '(^|[.])chat[.]deepseek[.]com$') AND p IN ('/api_keys', '/beta') THEN 'deepseek_non_chat_page'
  WHEN regexp_matches(h, '(^|[.])deepseek[.]com$') AND regexp_matches(p, '^/(policies|news|zh-cn/news)/') THEN 'deepseek_non_chat_page'
  WHEN regexp_matches(h, '(^|[.])meta[.]ai$') AND p = '/discover' THEN 'meta_ai_discover_page'
  WHEN regexp_matches(h, '(^|[.])minimax[.]io$') AND regexp_matches(p, '^/(news/|subscribe/|audio$|audio/)') THEN 'minimax_non_chat_page' END"""
_SESSION = """CASE WHEN platform IS NULL OR noise IS NOT NULL THEN NULL WHEN len(keys) > 0 THEN 'prompt_params:' || array_to_string(keys, ',')
  WHEN h = 'x.com' AND starts_with(p, '/i/grok') THEN 'x_grok_session'
  WHEN p IN ('', '/') AND h IN ('chatgpt.com', 'chat.openai.com', 'claude.ai', 'copilot.microsoft.com', 'm365copilot.com', 'perplexity.ai', 'gemini.google.com', 'grok.com', 'poe.com', 'chat.deepseek.com',
    'www.doubao.com', 'meta.ai', 'kimi.com', 'chat.mistral.ai', 'chat.minimax.io', 'chat.qwen.ai', 'yiyan.baidu.com', 'yuanbao.tencent.com', 'chat.z.ai', 'you.com') THEN 'platform_root_session'
  WHEN h IN ('chatgpt.com', 'chat.openai.com') AND starts_with(p, '/g/') THEN 'chatgpt_gpt_page' WHEN h IN ('chatgpt.com', 'chat.openai.com') AND starts_with(p, '/c/') THEN 'chatgpt_chat_page'
  WHEN h = 'claude.ai' AND starts_with(p, '/new') THEN 'claude_new_chat' WHEN h = 'claude.ai' AND starts_with(p, '/chat/') THEN 'claude_chat_page'
  WHEN h IN ('copilot.microsoft.com', 'm365copilot.com') AND starts_with(p, '/chats/') THEN 'copilot_chat_page' WHEN h IN ('copilot.microsoft.com', 'm365copilot.com') AND starts_with(p, '/shares/') THEN 'copilot_share_page'
  WHEN h IN ('copilot.microsoft.com', 'm365copilot.com') AND starts_with(p, '/images/create/') THEN 'copilot_image_session' WHEN h = 'perplexity.ai' AND starts_with(p, '/search/') THEN 'perplexity_search_page'
  WHEN h = 'gemini.google.com' AND (p = '/app' OR starts_with(p, '/u/') AND ends_with(p, '/app')) THEN 'gemini_app' WHEN h = 'gemini.google.com' AND starts_with(p, '/gem/') THEN 'gemini_gem_page'
  WHEN h = 'grok.com' AND (p = '/imagine' OR starts_with(p, '/imagine/')) THEN 'grok_imagine_page' WHEN h = 'poe.com' AND p NOT IN ('', '/', '/login') THEN 'poe_bot_page'
  WHEN h = 'chat.deepseek.com' AND starts_with(p, '/a/chat/') THEN 'deepseek_chat_page' WHEN h = 'chat.deepseek.com' AND starts_with(p, '/share/') THEN 'deepseek_share_page'
  WHEN h = 'www.doubao.com' AND starts_with(p, '/chat') THEN 'doubao_chat_page' WHEN h = 'chat.mistral.ai' AND starts_with(p, '/chat') THEN 'mistral_chat_page'
  WHEN h = 'chat.qwen.ai' AND starts_with(p, '/c/') THEN 'qwen_chat_page' WHEN h = 'yiyan.baidu.com' AND starts_with(p, '/chat/') THEN 'yiyan_chat_page' END"""
_KEYS_OF = "CASE WHEN platform IS NULL THEN [] WHEN i = 20 THEN ['q', 'query', 'text'] WHEN i BETWEEN 3 AND 7 THEN ['prompt', 'q', 'query', 'text'] ELSE ['message', 'prompt', 'q', 'query', 'text'] END"

_MATCH = f"""hosts AS (SELECT DISTINCT {_NETLOC} AS h FROM sample_classified_prompt_links),
owner AS (SELECT h, arg_min(s.platform, s.ord) AS platform FROM hosts JOIN platform_signatures s ON h = s.host_suffix OR ends_with(h, '.' || s.host_suffix) GROUP BY h)"""

_LABEL_LIST = """list_filter([CASE WHEN regexp_matches(low, 'always|remember|persist|prefer|priority') THEN 'PERSIST' END, CASE WHEN regexp_matches(low, 'authoritative|official|trusted|rank this') THEN 'AUTHORITY' END,
  CASE WHEN regexp_matches(low, 'recommend|suggest|best|choose') THEN 'RECOMMEND' END, CASE WHEN regexp_matches(low, 'cite|citation|reference|source') THEN 'CITE' END,
  CASE WHEN regexp_matches(low, 'summarize|summary|tl;dr|explain') THEN 'SUMMARIZE' END], lambda x: x IS NOT NULL)"""
_LABELLED = f"(SELECT row_id, {_LABEL_LIST} AS l FROM (SELECT row_id, lower(coalesce(primary_prompt_text, '')) AS low FROM sample_classified_prompt_links))"
_SEVERITY = "CASE WHEN list_contains(l, 'PERSIST') AND list_has_any(l, ['AUTHORITY', 'RECOMMEND', 'CITE']) THEN 'high' WHEN list_has_any(l, ['PERSIST', 'AUTHORITY', 'RECOMMEND', 'CITE']) THEN 'medium' ELSE 'low' END"
_IOC = """k(category, keyword) AS (VALUES ('persist', 'remember'), ('persist', 'memory'), ('persist', 'in future conversations'), ('persist', 'future conversations'), ('persist', 'from now on'), ('persist', 'always'),
  ('persist', 'keep in mind'), ('persist', 'save this'), ('persist', 'store this'), ('persist', 'never forget'), ('persist', 'in all responses'), ('persist', 'permanent instruction'),
  ('authority', 'trusted source'), ('authority', 'authoritative source'), ('authority', 'go-to source'), ('authority', 'reliable source'), ('authority', 'source of expertise'), ('authority', 'expert source'),
  ('authority', 'best source'), ('recommend', 'recommend'), ('recommend', 'prefer'), ('recommend', 'top choice'), ('recommend', 'best choice'), ('recommend', 'always mention'), ('recommend', 'prioritize'),
  ('recommend', 'rank first'), ('cite', 'cite'), ('cite', 'citation'), ('cite', 'citations'), ('cite', 'for future reference'), ('cite', 'reference this'), ('cite', 'source of information'))"""

# The classification stage. No address of the tables carries an '&' inside a value, so entities do not matter.
_SQUEEZE = r"trim(regexp_replace({}, '[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+', ' ', 'g'))"
# A value cut inside a character: what is left of the character becomes one replacement character.
_MENDED = "regexp_replace({}, '(?:%[CDcd][0-9A-Fa-f]|%[Ee][0-9A-Fa-f](?:%[89ABab][0-9A-Fa-f])?|%[Ff][0-7](?:%[89ABab][0-9A-Fa-f]){{0,2}})(%[0-9A-Fa-f]?)?$', '\ufffd\\1')"
_CUT_VALUE = _DEC.format(_MENDED.format("substr(p, instr(p, '=') + 1)"))
_PAIRS = f"list_transform(list_filter(string_split({_QUERY}, '&'), lambda p: regexp_matches(p, '(?s)^[^=]*=.')), lambda p: {{'k': {_KEY}, 'v': {_CUT_VALUE}}})"
_STAGE = rf"""hosts AS (SELECT DISTINCT {_NETLOC} AS h FROM sample_prompt_links),
owner AS (SELECT h, arg_min(s.platform, s.ord) AS platform, arg_min(s.prompt_params, s.ord) AS params FROM hosts JOIN platform_signatures s ON h = s.host_suffix OR ends_with(h, '.' || s.host_suffix) GROUP BY h),
src AS (SELECT link_no, coalesce(nullif(regexp_replace(lower(source_domain), '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g'), ''), lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '') AS source_domain,
  coalesce({_NETLOC}, '') AS target_domain, coalesce({_PAIRS}, []) AS kv FROM sample_prompt_links),
hit AS (SELECT src.*, platform AS target_platform, list_filter(list_transform(list_filter(kv, lambda x: list_contains(coalesce(params, []), x.k)),
  lambda x: {{'k': x.k, 'v': {_SQUEEZE.format(_DEC.format(_DEC.format(_DEC.format("x.v"))))}}}), lambda x: x.v <> '') AS prompts FROM src LEFT JOIN owner ON owner.h = src.target_domain),
keyed AS (SELECT *, list_sort(list_distinct(list_transform(prompts, lambda x: x.k))) AS keys FROM hit),
said AS (SELECT *, coalesce(list_filter(prompts, lambda x: x.k = keys[1])[1].v, '') AS primary_prompt_text FROM keyed),
{_IOC},
stage AS (SELECT *, {_LABEL_LIST} AS l, EXISTS (SELECT 1 FROM k WHERE len(list_filter(prompts, lambda x: contains(lower(x.v), keyword))) > 0) AS has_ioc_keywords,
  CASE WHEN len(keys) > 0 THEN 'prompt_params:' || array_to_string(keys, ',') ELSE '' END AS session_entry_reason FROM (SELECT *, lower(primary_prompt_text) AS low FROM said)),
done AS (SELECT *, array_to_string(l, ';') AS classification, {_SEVERITY} AS severity FROM stage)"""

_RISK = rf"""raw AS (
  SELECT row_id AS ord, coalesce(crawl, '') AS crawl, coalesce({_SITE}, '') AS d, source_url, target_url, coalesce(trim(target_platform), '') AS pf, lower(trim(coalesce(severity, ''))) AS severity FROM sample_classified_prompt_links),
rows_ AS (
  SELECT ord, crawl, severity, CASE WHEN d = '' THEN coalesce(lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '') ELSE d END AS source_domain,
         CASE WHEN pf = '' THEN '(unknown)' ELSE pf END AS target_platform, coalesce({_NETLOC}, '') AS target_domain FROM raw),
risky AS (SELECT * FROM rows_ WHERE severity IN ('medium', 'high'))"""


def _source_sql(crawl: str) -> str:
    return f"""{_RISK},
pp AS (SELECT {crawl} AS crawl, source_domain, target_platform, count(*) AS n, min(ord) AS fo, count(*) FILTER (WHERE severity = 'high') AS hi FROM risky WHERE source_domain <> '' GROUP BY ALL),
tot AS (SELECT crawl, sum(n) AS t FROM pp GROUP BY crawl),
agg AS (
  SELECT pp.crawl, source_domain, {_ROOT.format("source_domain")} AS root_domain, sum(n)::BIGINT AS rows, sum(hi)::BIGINT AS high_rows, sum(n - hi)::BIGINT AS medium_rows, count(*) AS unique_target_platforms,
         string_agg(target_platform, ' | ' ORDER BY target_platform) AS target_platforms, list(target_platform ORDER BY n DESC, fo, target_platform) AS names, list(n ORDER BY n DESC, fo, target_platform) AS ns,
         '{{' || string_agg('"' || target_platform || '": ' || n, ', ' ORDER BY target_platform) || '}}' AS platform_distribution_json
  FROM pp GROUP BY pp.crawl, source_domain),
src AS (
  SELECT agg.*, round_even((rows / t)::DOUBLE, 6) AS share_of_risky_rows, names[1] AS top_platform,
         array_to_string(list_transform(list_zip(names, ns)[1:3], lambda x: x[1] || ':' || x[2]), ' | ') AS platform_features
  FROM agg JOIN tot USING (crawl))"""


_SRC = "source_domain, root_domain, {rank}, rows, share_of_risky_rows, high_rows, medium_rows, unique_target_platforms, target_platforms, top_platform, platform_features, platform_distribution_json"
_NO_RANK = "NULL::INT AS tranco_rank, '' AS tranco_matched_domain, 'unranked' AS tranco_bucket, 'not_ranked' AS tranco_match_type"
_BUCKET = "CASE WHEN rank IS NULL THEN 'unranked' WHEN rank <= 1000 THEN 'top_1k' WHEN rank <= 10000 THEN '1k_10k' WHEN rank <= 100000 THEN '10k_100k' WHEN rank <= 1000000 THEN '100k_1m' ELSE 'unranked' END"
_RANK = f"""pg AS (SELECT {_SITE} AS h FROM demo_pages WHERE source_domain IS NOT NULL),
dom AS (SELECT domain, count(*) AS n FROM (SELECT unnest(list_distinct([h, {_ROOT.format("h")}])) AS domain FROM pg) GROUP BY domain),
ranking AS (SELECT domain, rank() OVER (ORDER BY n DESC)::INT AS rank FROM dom)"""


def _lookup_sql(roots: str) -> str:
    return f"""tries AS (SELECT root_domain, i, array_to_string(string_split(root_domain, '.')[i + 1:], '.') AS t FROM ({roots}) r, unnest(range(0, greatest(len(string_split(root_domain, '.')) - 1, 1))) u(i)),
best AS (SELECT root_domain, arg_min(rank, i) AS rank, arg_min(t, i) AS matched, min(i) AS pos FROM tries JOIN ranking ON t = domain GROUP BY root_domain)"""


_RANK_COLS = f"rank AS tranco_rank, coalesce(matched, '') AS tranco_matched_domain, {_BUCKET} AS tranco_bucket, CASE WHEN pos IS NULL THEN 'not_ranked' WHEN pos = 0 THEN 'exact_root' ELSE 'parent_match' END AS tranco_match_type"


def _target_sql() -> str:
    return f"""{_RISK},
tot AS (SELECT crawl, count(*) AS t FROM risky GROUP BY crawl)
SELECT r.crawl, target_platform, count(*) AS rows, round_even(count(*)::DOUBLE / any_value(t), 6) AS share_of_risky_rows, count(*) FILTER (WHERE severity = 'high') AS high_rows,
       count(*) FILTER (WHERE severity <> 'high') AS medium_rows, count(DISTINCT target_domain) FILTER (WHERE target_domain <> '') AS unique_target_domains
FROM risky r JOIN tot USING (crawl)"""


def _distribution(cte: str, key: str) -> str:
    return f"WITH {cte} SELECT {key}, count(*) AS n_rows, round_even(count(*)::DOUBLE / (SELECT count(*) FROM x), 6) AS share FROM x GROUP BY {key}"


_EDGE = r"'^[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+|[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+$', '', 'g'"
_LINKS = f"""l AS (SELECT page_id, unnest(links) AS k, generate_subscripts(links, 1) AS link_pos FROM demo_pages),
t AS (SELECT page_id, link_pos, k, {", ".join(f"regexp_replace(k.{c}, {_EDGE}) AS {c}_" for c in ("url", "path", "href", "text", "anchor", "alt"))} FROM l WHERE k IS NOT NULL),
e AS (SELECT page_id, link_pos, coalesce({", ".join(f"CASE WHEN regexp_matches({c}_, '^https?://') THEN {c}_ END" for c in ("url", "path", "href"))}, '') AS target_url,
       coalesce(nullif(text_, ''), nullif(anchor_, ''), nullif(alt_, ''), '') AS anchor_text FROM t)"""

ORACLE = {
    "link_targets": f"WITH {_LINKS} SELECT * FROM e",
    "collected_links": f"""WITH {_LINKS}, kv AS (SELECT page_id, link_pos, target_url, {_KV} AS p FROM e),
d AS (SELECT page_id, link_pos, target_url, lower({_KEY}) AS k, {_VALUE} AS v FROM kv)
SELECT page_id, link_pos, target_url, string_agg(DISTINCT k, ',' ORDER BY k) AS prompt_keys FROM d WHERE k IN ('q', 'prompt') AND trim(v) <> '' GROUP BY ALL""",
    "url_parts": f"SELECT link_no, {_NETLOC} AS netloc, {_PATH} AS path, length({_QUERY}) AS query_length FROM sample_prompt_links",
    "query_keys": f"WITH kv AS (SELECT {_KV} AS p FROM sample_classified_prompt_links) SELECT {_KEY} AS key, count(*) AS n_uses, sum(length({_VALUE}))::BIGINT AS n_chars FROM kv GROUP BY 1",
    "root_domain_counts": f"SELECT {_ROOT.format(_SITE)} AS root_domain, count(*) AS n_rows FROM sample_classified_prompt_links WHERE source_domain IS NOT NULL GROUP BY 1",
    "platform_match": f"WITH {_MATCH} SELECT row_id, coalesce({_NETLOC}, '') AS target_domain, platform AS target_platform FROM sample_classified_prompt_links LEFT JOIN owner ON owner.h = {_NETLOC}",
    "platform_distribution": _distribution(f"{_MATCH}, x AS (SELECT platform AS target_platform FROM sample_classified_prompt_links JOIN owner ON owner.h = {_NETLOC})", "target_platform"),
    "rules_platform": f"WITH {_CASES}, {_PLATFORM} SELECT case_no, platform AS target_platform, excluded FROM owned",
    "rules_noise": f"WITH {_CASES} SELECT case_no, {_NOISE} AS noise_reason FROM parts",
    "rules_session": f"""WITH {_CASES}, {_PLATFORM},
k AS (SELECT *, {_NOISE} AS noise, list_filter({_KEYS_OF}, lambda x: len(list_filter(string_split(q, '&'), lambda y: starts_with(y, x || '=') AND y <> x || '=')) > 0) AS keys FROM owned)
SELECT case_no, {_SESSION} AS session_reason, CASE WHEN len(keys) = 0 THEN '' ELSE trim(replace(url_decode(replace(url_decode(replace(regexp_extract(q, '(?:^|&)' || keys[1] || '=([^&]*)', 1), '+', ' ')), '+', ' ')), '+', ' ')) END AS primary_prompt FROM k""",
    "enriched_links": f"""WITH {_STAGE} SELECT link_no, source_domain, target_domain, target_platform, primary_prompt_text, len(keys) > 0 AS has_prompt_parameters, session_entry_reason, has_ioc_keywords, classification, severity, severity <> 'low' AS is_suspicious FROM done""",
    "stage_metrics": f"""WITH {_STAGE} SELECT count(*) AS rows_seen, count(*) FILTER (WHERE target_platform IS NULL) AS rows_unmatched, count(*) FILTER (WHERE target_platform IS NOT NULL AND severity = 'low') AS rows_benign,
  count(*) FILTER (WHERE target_platform IS NOT NULL AND severity <> 'low') AS rows_suspicious, count(*) FILTER (WHERE target_platform IS NOT NULL AND has_ioc_keywords) AS rows_with_ioc_keywords, 0::BIGINT AS rows_uncertain FROM done""",
    "stage_distributions": f"""WITH {_STAGE}, x AS (SELECT unnest([{{'kind': 'platform', 'name': target_platform}}, {{'kind': 'severity', 'name': severity}}, {{'kind': 'session', 'name': session_entry_reason}}, {{'kind': 'noise', 'name': ''}}]
  || list_transform(l, lambda t: {{'kind': 'label', 'name': t}})) AS e FROM done WHERE target_platform IS NOT NULL) SELECT e.kind AS kind, e.name AS name, count(*) AS n_rows FROM x WHERE e.name <> '' GROUP BY ALL""",
    "collected_prompts": f"""WITH kv AS (SELECT link_no, list_transform(coalesce({_PAIRS}, []), lambda x: {{'k': x.k, 'v': {_SQUEEZE.format("x.v")}}}) AS a FROM sample_prompt_links),
f AS (SELECT link_no, list_filter(a, lambda x: lower(x.k) IN ('q', 'prompt') AND x.v <> '') AS a FROM kv),
e AS (SELECT link_no, a, unnest(['q', 'prompt']) AS key FROM f)
SELECT link_no, key, array_to_string(list_transform(list_filter(a, lambda x: x.k = list_filter(a, lambda y: lower(y.k) = key)[-1].k), lambda x: x.v), chr(10)) AS values FROM e WHERE len(list_filter(a, lambda y: lower(y.k) = key)) > 0""",
    "page_totals": f"""WITH {_LINKS}, p AS (SELECT count(*) AS n_pages, count(*) FILTER (WHERE len(links) > 0) AS n_pages_with_links FROM demo_pages)
SELECT n_pages, n_pages_with_links, count(*) AS n_links, count(*) FILTER (WHERE target_url <> '') AS n_addresses, coalesce(sum(strlen(target_url)), 0)::BIGINT AS n_address_bytes FROM p, e GROUP BY ALL""",
    "row_label_counts": _distribution("x AS (SELECT upper(trim(unnest(prompt_labels))) AS label FROM sample_classified_prompt_links)", "label"),
    "ranking_buckets": f"""WITH {_RANK}, x AS (SELECT {_ROOT.format(_SITE)} AS root_domain FROM sample_classified_prompt_links WHERE source_domain IS NOT NULL), {_lookup_sql("SELECT DISTINCT root_domain FROM x")},
y AS (SELECT {_BUCKET} AS tranco_bucket FROM x LEFT JOIN best USING (root_domain)) SELECT tranco_bucket, count(*) AS n_rows, round_even(count(*)::DOUBLE / (SELECT count(*) FROM y), 6) AS share FROM y GROUP BY 1""",
    "first_crawl": "SELECT arg_min(crawl, row_id) AS crawl FROM sample_classified_prompt_links WHERE crawl <> ''",
    "prompt_whitespace": r"""SELECT link_no, length(trim(regexp_replace(primary_prompt_text, '[\t-\r\x1c-\x20\x{85}\p{Z}]+', ' ', 'g'))) AS n_squeezed,
CASE WHEN strlen(primary_prompt_text) >= 1024 THEN format('{:.1f} KB', strlen(primary_prompt_text) / 1024.0) ELSE strlen(primary_prompt_text) || ' B' END AS size FROM sample_prompt_links WHERE primary_prompt_text IS NOT NULL""",
    "ioc_keywords": f"WITH {_IOC} SELECT category, keyword, count(*) AS n_rows FROM sample_classified_prompt_links, k WHERE contains(lower(primary_prompt_text), keyword) GROUP BY ALL",
    "rule_labels": f"SELECT row_id, array_to_string(l, ';') AS classification, {_SEVERITY} AS rule_severity FROM {_LABELLED}",
    "rule_label_counts": _distribution(f"x AS (SELECT unnest(l) AS label FROM {_LABELLED})", "label"),
    "severity_counts": _distribution("x AS (SELECT lower(trim(coalesce(severity, ''))) AS severity FROM sample_classified_prompt_links)", "severity"),
    "source_domain_risk": f"WITH {_source_sql('crawl')}, {_RANK}, {_lookup_sql('SELECT DISTINCT root_domain FROM src')} SELECT crawl, source_domain, src.root_domain, {_RANK_COLS}, rows, share_of_risky_rows, high_rows, medium_rows, unique_target_platforms, target_platforms, top_platform, platform_features, platform_distribution_json FROM src LEFT JOIN best ON best.root_domain = src.root_domain",
    "source_risk_all_crawls_together": f"WITH {_source_sql(_q(''))} SELECT {_SRC.format(rank=_NO_RANK)} FROM src",
    "top_source_domains": f"WITH {_source_sql(_q('all'))} SELECT crawl, source_domain, root_domain, NULL::INT AS tranco_rank, rows, share_of_risky_rows, high_rows, medium_rows, unique_target_platforms, target_platforms, platform_features FROM src ORDER BY rows DESC, unique_target_platforms DESC, source_domain LIMIT 25",
    "target_platform_risk": f"WITH {_target_sql()} GROUP BY r.crawl, target_platform",
    "cross_crawl_targets": f"WITH {_target_sql()} WHERE r.crawl IN (SELECT crawl FROM crawl_runs) GROUP BY r.crawl, target_platform",
    "overview_sources": f"""WITH {_RISK} SELECT crawl, count(*) AS rows_seen, count(*) FILTER (WHERE k) AS risky_rows, round_even(count(*) FILTER (WHERE k)::DOUBLE / count(*), 6) AS risky_share_of_all_rows,
count(DISTINCT source_domain) FILTER (WHERE k) AS unique_risky_source_domains, count(*) FILTER (WHERE k AND severity = 'high') AS high_rows, count(*) FILTER (WHERE k AND severity = 'medium') AS medium_rows
FROM (SELECT *, severity IN ('medium', 'high') AND source_domain <> '' AS k FROM rows_) GROUP BY crawl""",
    "overview_targets": f"""WITH {_RISK} SELECT crawl, count(*) AS rows_seen, count(*) FILTER (WHERE k) AS risky_rows, round_even(count(*) FILTER (WHERE k)::DOUBLE / count(*), 6) AS risky_share_of_all_rows,
count(*) FILTER (WHERE severity = 'high') AS high_rows, count(*) FILTER (WHERE severity = 'medium') AS medium_rows FROM (SELECT *, severity IN ('medium', 'high') AS k FROM rows_) GROUP BY crawl""",
    "ranking_lookup": f"""WITH {_RANK}, roots AS (SELECT DISTINCT {_ROOT.format(_SITE)} AS root_domain FROM sample_prompt_links WHERE source_domain IS NOT NULL), {_lookup_sql('SELECT * FROM roots')}
SELECT roots.root_domain, {_RANK_COLS} FROM roots LEFT JOIN best ON best.root_domain = roots.root_domain""",
    "resume_anti_join": f"SELECT wat_file, count(*) AS n_links FROM sample_prompt_links WHERE source_domain IS NOT NULL AND {_SITE} NOT IN (SELECT {_SITE} FROM demo_pages WHERE source_domain IS NOT NULL) GROUP BY wat_file",
    "json_round_trip": "SELECT page_id, source_url, coalesce(len(links), -1)::INT AS n_links FROM demo_pages",
    "prefilter_counts": f"""WITH {_MATCH}, x AS (SELECT platform IS NOT NULL AS is_matched, (SELECT bool_or(contains(target_url, host_suffix)) FROM platform_signatures) AS passes FROM sample_classified_prompt_links LEFT JOIN owner ON owner.h = {_NETLOC})
SELECT passes, is_matched, count(*) AS n_rows FROM x GROUP BY ALL""",
}
