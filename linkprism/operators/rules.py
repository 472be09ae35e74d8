"""Rule tables and the expressions made from them: platforms, noise, sessions, keywords, labels."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkprism.functions import urls
from linkprism.functions.binding import let
from linkprism.functions.text import decode_to_fixpoint, keywords_in, squeeze, unescape_all

# Query keys that carry a prompt, by kind of platform.
_M = ("q", "prompt", "query", "message", "text")
_B = ("q", "prompt", "query", "text")
PROMPT_KEYS = _M


@dataclass(frozen=True)
class Signature:
    """A platform: host suffixes, prompt keys in order, excluded and required paths."""

    name: str
    suffixes: tuple[str, ...]
    params: tuple[str, ...]
    exact: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    require: tuple[str, ...] = field(default=())


# Assistants by host, in matching order.
SIGNATURES = (
    Signature("chatgpt", ("chatgpt.com", "chat.openai.com"), _M),
    Signature("claude", ("claude.ai",), _M, ("/download", "/login"), ("/public/artifacts/",)),
    Signature("copilot", ("copilot.microsoft.com", "m365copilot.com", "copilot.cloud.microsoft"), _M, ("/onboarding", "/prompts")),
    Signature("perplexity", ("perplexity.ai",), _B, ("/pro", "/comet"), ("/finance/", "/page/", "/hub/")),
    Signature("gemini", ("gemini.google.com",), _B, (), ("/share/",)),
    Signature("grok", ("grok.com",), _B),
    Signature("grok", ("x.com",), ("text", "q", "prompt", "query"), (), (), ("/i/grok",)),
    Signature("poe", ("poe.com",), _B),
    Signature("deepseek", ("chat.deepseek.com",), _M, ("/api_keys", "/beta")),
    Signature("deepseek", ("deepseek.com",), _M, (), ("/policies/", "/news/", "/zh-cn/news/")),
    Signature("doubao", ("doubao.com", "www.doubao.com"), _M),
    Signature("meta_ai", ("meta.ai", "www.meta.ai"), _M, ("/discover",)),
    Signature("kimi", ("kimi.com", "www.kimi.com"), _M),
    Signature("le_chat", ("chat.mistral.ai",), _M),
    Signature("minimax", ("minimax.io",), _M, ("/audio",), ("/news/", "/subscribe/", "/audio/")),
    Signature("minimax", ("chat.minimax.io", "agent.minimax.io"), _M),
    Signature("qwen", ("qwen.ai", "chat.qwen.ai"), _M),
    Signature("yiyan", ("yiyan.baidu.com",), _M),
    Signature("yuanbao", ("yuanbao.tencent.com",), _M),
    Signature("z_ai", ("z.ai", "chat.z.ai"), _M),
    Signature("you", ("you.com",), ("q", "query", "text")),
)

# Fixed values: (code, hosts, whether subdomains count, exact paths, path prefixes), in order. None: see noise_reason.
NOISE = (
    ("claude_artifact_page", ("claude.ai",), True, (), ("/public/artifacts/",)),
    ("claude_non_chat_page", ("claude.ai",), True, ("/download", "/login"), ()),
    ("copilot_non_chat_page", ("copilot.microsoft.com",), True, ("/onboarding", "/prompts"), ()),
    ("gemini_share_page", ("gemini.google.com",), False, (), ("/share/",)),
    ("perplexity_non_chat_page", ("perplexity.ai",), True, ("/pro", "/comet"), ("/finance/", "/page/", "/hub/")),
    ("deepseek_non_chat_page", ("chat.deepseek.com",), True, ("/api_keys", "/beta"), ()),
    ("deepseek_non_chat_page", ("deepseek.com",), True, (), ("/policies/", "/news/", "/zh-cn/news/")),
    ("meta_ai_discover_page", ("meta.ai",), True, ("/discover",), ()),
    ("minimax_non_chat_page", ("minimax.io",), True, ("/audio",), ("/news/", "/subscribe/", "/audio/")),
)

# Hosts whose root page opens a session.
ROOT_SESSION_HOSTS = [
    "chatgpt.com", "chat.openai.com", "claude.ai", "copilot.microsoft.com", "m365copilot.com", "copilot.cloud.microsoft", "perplexity.ai", "gemini.google.com", "grok.com", "poe.com",
    "chat.deepseek.com", "doubao.com", "www.doubao.com", "meta.ai", "www.meta.ai", "kimi.com", "www.kimi.com", "chat.mistral.ai", "chat.minimax.io", "agent.minimax.io", "chat.qwen.ai",
    "yiyan.baidu.com", "yuanbao.tencent.com", "chat.z.ai", "you.com",
]

# Fixed values: (code, exact hosts, path pattern), in order.
SESSIONS = (
    ("chatgpt_gpt_page", ("chatgpt.com", "chat.openai.com"), "^/g/"),
    ("chatgpt_chat_page", ("chatgpt.com", "chat.openai.com"), "^/c/"),
    ("claude_new_chat", ("claude.ai",), "^/new"),
    ("claude_chat_page", ("claude.ai",), "^/chat/"),
    ("copilot_chat_page", ("copilot.microsoft.com", "m365copilot.com", "copilot.cloud.microsoft"), "^/chats/"),
    ("copilot_share_page", ("copilot.microsoft.com", "m365copilot.com", "copilot.cloud.microsoft"), "^/shares/"),
    ("copilot_image_session", ("copilot.microsoft.com", "m365copilot.com", "copilot.cloud.microsoft"), "^/images/create/"),
    ("perplexity_search_page", ("perplexity.ai",), "^/search/"),
    ("gemini_app", ("gemini.google.com",), "^/app$|^/u/.*/app$"),
    ("gemini_gem_page", ("gemini.google.com",), "^/gem/"),
    ("grok_imagine_page", ("grok.com",), "^/imagine(/|$)"),
    ("poe_bot_page", ("poe.com",), "^(?!/(login)?$)"),
    ("deepseek_chat_page", ("chat.deepseek.com",), "^/a/chat/"),
    ("deepseek_share_page", ("chat.deepseek.com",), "^/share/"),
    ("doubao_chat_page", ("doubao.com", "www.doubao.com"), "^/chat"),
    ("mistral_chat_page", ("chat.mistral.ai",), "^/chat"),
    ("qwen_chat_page", ("chat.qwen.ai",), "^/c/"),
    ("yiyan_chat_page", ("yiyan.baidu.com",), "^/chat/"),
)

# Keywords by category.
IOC_KEYWORDS = {
    "persist": ["remember", "memory", "in future conversations", "future conversations", "from now on", "always", "keep in mind", "save this", "store this", "never forget", "in all responses", "permanent instruction"],
    "authority": ["trusted source", "authoritative source", "go-to source", "reliable source", "source of expertise", "expert source", "best source"],
    "recommend": ["recommend", "prefer", "top choice", "best choice", "always mention", "prioritize", "rank first"],
    "cite": ["cite", "citation", "citations", "for future reference", "reference this", "source of information"],
}

# Terms of the rule classifier, labels in output order.
LABEL_TERMS = {
    "PERSIST": ["always", "remember", "persist", "prefer", "priority"],
    "AUTHORITY": ["authoritative", "official", "trusted", "rank this"],
    "RECOMMEND": ["recommend", "suggest", "best", "choose"],
    "CITE": ["cite", "citation", "reference", "source"],
    "SUMMARIZE": ["summarize", "summary", "tl;dr", "explain"],
}
LABELS = list(LABEL_TERMS)
# Fixed value: labels that make persistence severe.
_NEED_PERSIST = ("AUTHORITY", "RECOMMEND", "CITE")


def signatures_from(table: DataFrame) -> tuple[Signature, ...]:
    """Signatures from a rule table (ord, platform, host_suffix, prompt_params), one row per host; its size is that of the rule set."""
    by: dict[tuple[int, str], dict] = {}
    for r in table.orderBy("ord", "host_suffix").collect():
        x = by.setdefault((r["ord"], r["platform"]), {"hosts": [], "params": tuple(r["prompt_params"] or ())})
        x["hosts"].append(r["host_suffix"])
    return tuple(Signature(name, tuple(x["hosts"]), x["params"]) for (_, name), x in sorted(by.items()))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _host_in(h: Column, suffixes, subdomains: bool = True) -> Column:
    own = h.isin(*suffixes)
    return own | _any(h.endswith(f".{s}") for s in suffixes) if subdomains else own


def _path_in(p: Column, exact, prefixes) -> Column:
    return _any([*([p.isin(*exact)] if exact else []), *(p.startswith(x) for x in prefixes)])


def platform_index(h: Column, p: Column, signatures=SIGNATURES) -> Column:
    """Number of the matching signature; -1 if a signature's path exclusion stops the search, null if none matches.

    The host and its parents are looked up in a literal map from suffix to signatures,
    so host and path enter the plan once, however many rules there are.
    """
    owners: dict[str, list[int]] = {}
    for i, s in enumerate(signatures):
        for x in s.suffixes:
            owners.setdefault(x, []).append(i)
    if not owners:
        return F.lit(None).cast("int")
    by_suffix = F.create_map(*[c for x, ids in owners.items() for c in (F.lit(x), F.array(*[F.lit(i) for i in ids]))])

    def parents(labels: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    found = let(F.split(h, r"\."), lambda labels: F.filter(F.transform(parents(labels), lambda x: F.try_element_at(by_suffix, x)), lambda x: x.isNotNull()))
    ids = F.array_sort(F.array_distinct(F.flatten(found)))

    def outcome(i: Column, p: Column) -> Column:
        out = None
        for k, s in enumerate(signatures):
            for cond, value in (
                *([(_path_in(p, s.exact, s.prefixes), F.lit(-1))] if s.exact or s.prefixes else []),
                *([(~_any(p.startswith(x) for x in s.require), F.lit(None).cast("int"))] if s.require else []),
            ):
                out = F.when((i == k) & cond, value) if out is None else out.when((i == k) & cond, value)
        return i if out is None else out.otherwise(i)

    return let(p, lambda path: F.get(F.filter(F.transform(ids, lambda i: outcome(i, path)), lambda x: x.isNotNull()), F.lit(0)))


def matched(df: DataFrame, url: str, signatures=SIGNATURES) -> DataFrame:
    """``df`` with ``target_domain``, ``target_path``, ``signature`` and ``target_platform``; the latter two null without a match."""
    c = F.col(url)
    split = df.withColumns({"target_domain": F.coalesce(urls.netloc(c), F.lit("")), "target_path": F.lower(F.coalesce(urls.path(c), F.lit("")))})
    found = split.withColumn("signature", platform_index(F.col("target_domain"), F.col("target_path"), signatures))
    names = F.array(*[F.lit(s.name) for s in signatures])
    return found.withColumn("target_platform", let(F.col("signature"), lambda i: F.when(i >= 0, F.get(names, i))))


def prefilter(line: Column, signatures=SIGNATURES) -> Column:
    """Case-sensitive substring test for any host suffix in a raw line: the cheap first predicate."""
    return _any(line.contains(s) for s in dict.fromkeys(x for g in signatures for x in g.suffixes))


def prompt_parameters(df: DataFrame, url: str, signatures=SIGNATURES) -> DataFrame:
    """Adds ``prompt_parameters`` map<string,array<string>> of a matched row (see ``matched``).

    Keys are case-sensitive and in signature order; values are decoded to a fixpoint,
    stripped of entities and squeezed; blank values and keys without values are left out.
    """
    by_rule = F.array(*[F.array(*[F.lit(k) for k in s.params]) for s in signatures])
    keys = F.coalesce(F.get(by_rule, F.when(F.col("signature") >= 0, F.col("signature"))), F.array().cast("array<string>"))
    asked = df.withColumn("__lp_keys", keys)
    asked = asked.withColumn("__lp_kv", F.filter(F.when(F.size("__lp_keys") > 0, urls.parameters(F.col(url))), lambda x: F.array_contains("__lp_keys", x["k"])))
    plain = asked.withColumn("__lp_v", unescape_all(F.transform("__lp_kv", lambda x: x["v"])))
    pairs = F.zip_with("__lp_kv", "__lp_v", lambda a, b: F.struct(a["k"].alias("k"), squeeze(decode_to_fixpoint(b)).alias("v")))

    def by_key(kv: Column) -> Column:
        present = F.filter("__lp_keys", lambda k: F.exists(kv, lambda x: x["k"] == k))
        return F.map_from_entries(F.transform(present, lambda k: F.struct(k, F.transform(F.filter(kv, lambda x: x["k"] == k), lambda x: x["v"]))))

    found = let(F.filter(pairs, lambda x: x["v"] != ""), by_key)
    return plain.withColumn("prompt_parameters", F.coalesce(found, F.create_map().cast("map<string,array<string>>"))).drop("__lp_kv", "__lp_v", "__lp_keys")


def flattened(params: Column) -> Column:
    """All values by alphabetical key."""
    return F.flatten(F.transform(F.array_sort(F.map_keys(params)), lambda k: params[k]))


def primary_prompt(params: Column) -> Column:
    return F.coalesce(F.get(flattened(params), 0), F.lit(""))


def noise_code(h: Column, p: Column, has_prompt: Column) -> Column:
    """Code of a structural noise page from host, lower-case path and whether a prompt key has a value; else null."""
    out = F.when((F.coalesce(h, F.lit("")) == "") | F.coalesce(has_prompt, F.lit(False)), F.lit(None).cast("string"))
    out = out.when(_host_in(h, ("x.com",)) & ~p.startswith("/i/grok"), F.lit("x_non_grok_path"))
    for code, hosts, sub, exact, prefixes in NOISE:
        out = out.when(_host_in(h, hosts, sub) & _path_in(p, exact, prefixes), F.lit(code))
    return out


def _place(url: Column) -> Column:
    has_prompt = F.exists(urls.parameters(url), lambda x: x["k"].isin(*_M))
    return F.struct(urls.netloc(url).alias("h"), F.lower(urls.path(url)).alias("p"), has_prompt.alias("m"))


def noise_reason(url: Column) -> Column:
    """Code of a structural noise page, or null; an explicit prompt key is never noise."""
    return let(_place(url), lambda x: noise_code(x["h"], x["p"], x["m"]))


def session_code(h: Column, p: Column, noise: Column, platform: Column, params: Column) -> Column:
    """Why a link opens a session from host, lower-case path and noise code; the first rule that holds, else null."""
    p = F.when(p == "", F.lit("/")).otherwise(p)
    out = F.when(platform.isNull() | noise.isNotNull(), F.lit(None).cast("string"))
    out = out.when(F.size(params) > 0, F.concat(F.lit("prompt_params:"), F.array_join(F.array_sort(F.map_keys(params)), ",")))
    out = out.when((h == "x.com") & p.startswith("/i/grok") & (platform == "grok"), F.lit("x_grok_session"))
    out = out.when(h.isin(*ROOT_SESSION_HOSTS) & (p == "/"), F.lit("platform_root_session"))
    for code, hosts, pattern in SESSIONS:
        out = out.when(h.isin(*hosts) & p.rlike(pattern), F.lit(code))
    return out


def session_reason(url: Column, platform: Column, params: Column) -> Column:
    """Why a link opens a session, or null."""
    return let(_place(url), lambda x: session_code(x["h"], x["p"], noise_code(x["h"], x["p"], x["m"]), platform, params))


def ioc_columns(params: Column) -> dict[str, Column]:
    """Keyword indicators of the prompt parameters: keys, patterns, hits by category, categories, flag."""
    everything = [k for ks in IOC_KEYWORDS.values() for k in ks]
    hit_keys = F.filter(F.array_sort(F.map_keys(params)), lambda k: F.exists(params[k], lambda v: let(F.lower(v), lambda low: _any(low.contains(w) for w in everything))))

    def found(values: Column, words: list[str]) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.transform(values, lambda v: keywords_in(v, words)))))

    hits = let(
        F.flatten(F.map_values(params)),
        lambda values: F.map_filter(F.create_map(*[x for c in sorted(IOC_KEYWORDS) for x in (F.lit(c), found(values, IOC_KEYWORDS[c]))]), lambda _, v: F.size(v) > 0),
    )
    return {
        "ioc_parameter_keys": F.array_sort(F.map_keys(params)),
        "ioc_parameter_patterns": F.transform(hit_keys, lambda k: F.concat(F.lit("?"), k, F.lit("="))),
        "ioc_keyword_hits": hits,
        "ioc_keyword_categories": F.array_sort(F.map_keys(hits)),
        "has_ioc_keywords": F.size(hits) > 0,
    }


def rule_labels(text: Column) -> Column:
    """Labels whose terms occur in the lower-case text, in fixed order; null text has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(_any(low.contains(t) for t in terms), F.lit(name)) for name, terms in LABEL_TERMS.items()]))


def severity(labels: Column) -> Column:
    strong = F.arrays_overlap(labels, F.array(*[F.lit(x) for x in _NEED_PERSIST]))
    persist = F.array_contains(labels, "PERSIST")
    return F.when(persist & strong, F.lit("high")).when(persist | strong, F.lit("medium")).otherwise(F.lit("low"))


def classified(df: DataFrame, labels: Column, tier: str = "rule", method: str = "rule", model: str = "", probabilities: Column | None = None, uncertain: Column | None = None) -> DataFrame:
    """Adds the classification columns from a label array; unknown labels are dropped, the order is fixed."""
    known = F.filter(F.array(*[F.lit(x) for x in LABELS]), lambda x: F.array_contains(labels, x))
    probs = probabilities if probabilities is not None else F.create_map(*[x for n in LABELS for x in (F.lit(n), F.when(F.array_contains(F.col("prompt_labels"), n), 0.9).otherwise(0.05))])
    return (
        df.withColumn("prompt_labels", known)
        .withColumns({"classification": F.array_join("prompt_labels", ";"), "severity": severity(F.col("prompt_labels"))})
        .withColumns(
            {
                "is_suspicious": F.col("severity") != "low",
                "classification_tier": F.lit(tier),
                "classification_method": F.lit(method),
                "classification_model_name": F.lit(model),
                "classification_probabilities": F.transform_values(probs, lambda _, v: F.bround(v, 4)),
                "classification_is_uncertain": uncertain if uncertain is not None else F.lit(False),
            }
        )
    )
