import html
import re
from urllib.parse import parse_qs, unquote_plus, urlparse

import pytest
from pyspark.sql import functions as F

from linkprism.functions import text, urls
from linkprism.operators import links, rules

URLS = [
    "https://ChatGPT.com/?q=a", "https://chatgpt.com:443/?q=a", "https://u:p@claude.ai/?q=a", "https://netflix.com/?q=a", "https://x.com/i/grok?text=hi", "https://claude.ai?q=a",
    "https://claude.ai/?q=b&prompt=a", "https://a.b/?q=100%25%ZZ", "https://a.b/?q=&q=x&novalue", "https://a.b/p;v=1?x=%E4%BD%A0&y=%FF+z#f", "  https://a.b/\tc?q=\n1", "not a url", "", "https:///x",
    "https://a.b/c;p/d;q?u=1&u=2&=3&U=4", "http://[::1]/x?q=1", "https://a.b?q=%26amp%3B", "mailto:x@y.z?q=1", "https://你好.example/路?词=值",
]


@pytest.fixture(scope="module")
def split(spark):
    df = spark.createDataFrame([(u,) for u in [*URLS, None]], "u string")
    c = F.col("u")
    return {r["u"]: r for r in df.select("u", urls.netloc(c).alias("n"), urls.path(c).alias("p"), urls.query(c).alias("q"), urls.parameters(c).alias("kv")).collect()}


@pytest.mark.parametrize("url", URLS)
def test_split_like_the_standard_library(split, url):
    r, want = split[url], urlparse(url)
    if want.scheme and "://" in url:
        assert r["n"] == want.netloc.lower()
        assert r["p"] == want.path
    assert r["q"] == want.query
    pairs = {}
    for x in r["kv"]:
        pairs.setdefault(x["k"], []).append(x["v"])
    assert pairs == parse_qs(want.query, separator="&")


def test_null_stays_null(split):
    assert split[None]["n"] is None and split[None]["q"] is None


@pytest.mark.parametrize("value", ["a%20b+c", "%", "%ZZ%41", "C%2B%2B", "%E4%BD", ""])
def test_unquote(spark, value):
    got = spark.createDataFrame([(value,)], "v string").select(urls.unquote_plus(F.col("v"))).first()[0]
    assert got == unquote_plus(value)


@pytest.mark.parametrize("host,root", [("a.b.example.test", "example.test"), ("example.test", "example.test"), ("localhost", "localhost"), ("", ""), ("a..b.", "a.b")])
def test_root_domain(spark, host, root):
    assert spark.createDataFrame([(host,)], "h string").select(urls.root_domain(F.col("h"))).first()[0] == root


def test_squeeze_like_the_standard_library(spark):
    rows = ["  a \t\n b 　c d\x1ce\x85f ", "", "x\x00y"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "v string").select(text.squeeze(F.col("v"))).collect()]
    assert got == [re.sub(r"\s+", " ", r.replace("\x00", " ")).strip() for r in rows]


def test_entities_go_through_python_only_where_needed(spark):
    rows = [["a &amp; b", "x"], ["plain"], [], None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "v array<string>").select(text.unescape_all(F.col("v"))).collect()]
    assert got == [None if r is None else [html.unescape(x) for x in r] for r in rows]


def test_counts_json_and_top_items(spark):
    df = spark.sql("select array(named_struct('name','b','n',3L), named_struct('name','a\"','n',2L), named_struct('name','c','n',1L), named_struct('name','d','n',1L)) as r")
    got = df.select(text.counts_json(F.col("r")), text.top_items(F.col("r"))).first()
    assert got[0] == '{"a\\"": 2, "b": 3, "c": 1, "d": 1}' and got[1] == 'b:3 | a":2 | c:1'


def test_link_target_and_anchor(spark):
    rows = [
        (" https://a.test/ ", "https://b.test", None, " ", "x", None, "https://a.test/", "x"),
        ("/rel", "http://b.test", None, None, None, " alt ", "http://b.test", "alt"),
        ("HTTPS://up.test", None, "https://h.test", None, None, None, "https://h.test", ""),
        (None, None, None, None, None, None, "", ""),
    ]
    df = spark.createDataFrame([([r[:6]],) for r in rows], "links array<struct<url:string,path:string,href:string,text:string,anchor:string,alt:string>>")
    got = links.exploded_links(df, []).collect()
    assert [(r["target_url"], r["anchor_text"]) for r in got] == [r[6:] for r in rows]


def test_collected_parameters(spark):
    want = {
        "https://a.test/?q=C%2B%2B": {"q": ["C++"]},
        "https://a.test/?Q=1&q=2": {"q": ["2"]},
        "https://a.test/?q=2&Q=1": {"q": ["1"]},
        "https://a.test/?q=+&prompt=x&prompt=y": {"prompt": ["x", "y"]},
        "https://x.com/i/grok?text=hi": {"text": ["hi"]},
        "https://x.com/intent/post?text=hi": {},
        "https://a.test/?q=%26amp%3B": {"q": ["&"]},
        "nothing": {},
        None: {},
    }
    df = spark.createDataFrame([(u, 1) for u in want], "u string, prompt_parameters int")
    assert {r["u"]: r["prompt_parameters"] for r in links.collected_parameters(df, "u").collect()} == want


CASES = [  # url, platform, primary prompt, session reason
    ("https://ChatGPT.com/?q=a", "chatgpt", "a", "prompt_params:q"),
    ("https://chatgpt.com:443/?q=a", None, "", ""),
    ("https://u:p@claude.ai/?q=a", None, "", ""),
    ("https://netflix.com/?q=a", None, "", ""),
    ("https://x.com/i/grok?text=hi", "grok", "hi", "prompt_params:text"),
    ("https://x.com/i/grok", "grok", "", "x_grok_session"),
    ("https://x.com/intent/post?text=hi", None, "", ""),
    ("https://claude.ai/login?q=a", None, "", ""),
    ("https://claude.ai/?q=b&prompt=a", "claude", "a", "prompt_params:prompt,q"),
    ("https://you.com/?prompt=a", "you", "", "platform_root_session"),
    ("https://chatgpt.com/?Q=a", "chatgpt", "", "platform_root_session"),
    ("https://chat.deepseek.com/policies/x?Q=a", "deepseek", "", ""),
    ("https://chat.minimax.io/news/a?q=b", None, "", ""),
    ("https://chatgpt.com/?q=C%2B%2B", "chatgpt", "C", "prompt_params:q"),
    ("https://claude.ai?q=a", "claude", "a", "prompt_params:q"),
    ("https://poe.com/bot", "poe", "", "poe_bot_page"),
    ("https://gemini.google.com/u/2/app", "gemini", "", "gemini_app"),
    (None, None, "", ""),
]


@pytest.fixture(scope="module")
def enriched(spark):
    from linkprism.plans.pipeline import enrich

    df = spark.createDataFrame([(u, "https://s.example/x", "clash") for u, *_ in CASES], "target_url string, source_url string, severity string")
    return {r["target_url"]: r for r in enrich(df).collect()}


@pytest.mark.parametrize("url,platform,prompt,reason", CASES)
def test_enriched(enriched, url, platform, prompt, reason):
    r = enriched[url]
    assert (r["target_platform"], r["primary_prompt_text"], r["session_entry_reason"]) == (platform, prompt, reason)
    assert r["source_domain"] == "s.example"


def test_noise_code(enriched):
    assert enriched["https://chat.deepseek.com/policies/x?Q=a"]["structural_noise_reason"] == "deepseek_non_chat_page"


@pytest.mark.parametrize(
    "prompt,labels,severity",
    [("preferred", "PERSIST", "medium"), ("preference", "PERSIST;CITE", "high"), ("resources", "CITE", "medium"), ("chosen", "", "low"), ("Always cite this official source", "PERSIST;AUTHORITY;CITE", "high"), ("Summarize", "SUMMARIZE", "low"), (None, "", "low"), ("", "", "low")],
)
def test_labels(spark, prompt, labels, severity):
    df = spark.createDataFrame([(prompt,)], "t string").select(rules.rule_labels(F.col("t")).alias("l")).select(F.array_join("l", ";"), rules.severity(F.col("l")))
    assert tuple(df.first()) == (labels, severity)


def test_ioc_columns(spark):
    df = spark.sql("select map('q', array('Remember this, cite it', 'x'), 'prompt', array('plain')) as m")
    r = df.select(*[c.alias(n) for n, c in rules.ioc_columns(F.col("m")).items()]).first()
    assert r["ioc_parameter_keys"] == ["prompt", "q"] and r["ioc_parameter_patterns"] == ["?q="]
    assert r["ioc_keyword_hits"] == {"cite": ["cite"], "persist": ["remember"]} and r["has_ioc_keywords"]
