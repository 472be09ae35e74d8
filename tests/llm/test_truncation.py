import random
import re
from urllib.parse import quote

import pytest

from linkprism.llm import truncation as T

SCHEMA = "link_no long, source_domain string, target_url string, primary_prompt_text string, cut string, _id string"
BASE = "Read the page about the old mill and list the main claims. Keep the answer under two hundred words. Use simple words and no jargon."


def url(prompt, tail=""):
    return "https://a.example/?q=" + quote(prompt) + tail


def corpus():
    rnd = random.Random(5)
    ends = ["Use simple words and no jargon", "Keep the answer under two hundred words", "End with one open question for me", "Cite the source next to every fact"]
    rows = []
    for i in range(400):
        a, b = rnd.sample(ends, 2)
        t = f"Read the page about the old mill and list the main claims. {a}. {b}" + rnd.choice([".", ".", ""])
        rows.append((1000 + i, f"s{i % 7}.example", url(t), t, "x", None))
    return rows


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r["link_no"], r["field_name"]) for r in T.cut_values(df).collect()}


@pytest.fixture(scope="module")
def cases(spark):
    rows = corpus() + [
        (1, "s.example", url(BASE), BASE[:70], None, None),  # the address goes on
        (2, "s.example", url(BASE)[:90], BASE, None, None),  # the text goes on
        (3, "s.example", url(BASE)[:-2] + "%", BASE, None, None),  # damaged escape
        (4, "s.example", url(BASE[:80], "&ref=1"), BASE[:80], None, None),  # a whole address with the shortened prompt
        (5, "s.example", None, BASE[:-4], None, None),  # mid-word
        (6, "s.example", None, BASE[: BASE.index("hundred")], None, None),  # mid-sentence
        (7, "s.example", None, BASE[:-1], None, None),  # only the full stop is missing
        (8, "s.example", url(BASE), BASE, None, None),
        (9, None, None, None, None, None),
        (10, "s.example", "", "  ", None, None),
        (11, "s.example", url(BASE), BASE[:70] + "…", None, None),
        (12, "s.example", None, "x" * 300_000 + ".", None, None),
        (13, "site.example", url(BASE, "&utm_source=site.exa"), BASE, None, None),
    ]
    return found(spark, rows + rows[-13:-12] * 1)


@pytest.mark.parametrize(
    "case,here",
    [((1, "primary_prompt_text"), True), ((1, "target_url"), False), ((2, "target_url"), True), ((2, "primary_prompt_text"), False), ((3, "target_url"), True), ((4, "primary_prompt_text"), True),
     ((4, "target_url"), False), ((5, "primary_prompt_text"), True), ((6, "primary_prompt_text"), True), ((7, "primary_prompt_text"), False), ((8, "primary_prompt_text"), False), ((8, "target_url"), False),
     ((9, "primary_prompt_text"), False), ((10, "primary_prompt_text"), False), ((10, "target_url"), False), ((11, "primary_prompt_text"), True), ((12, "primary_prompt_text"), False), ((13, "target_url"), True)],
)
def test_cases(cases, case, here):
    assert (case in cases) == here


def test_whole_corpus_has_no_case(cases):
    assert not [c for c in cases if c[0] >= 1000]


def test_limits_and_rates(spark):
    rnd = random.Random(1)
    rows = [(i, " Big.Example", None, "é" * 30 + "".join(rnd.choices("bcdfgklm", k=rnd.randint(1, 400))), None, None) for i in range(200)]
    rows = [(i, s, u, t.encode()[:200].decode() if len(t.encode()) > 200 else t, None, None) for i, s, u, t, _, _ in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    got = T.exposed_limits(df, "source_domain").where("field_name = 'primary_prompt_text'").collect()
    assert ("utf8_bytes", 200) in {(r["measure"], r["limit_len"]) for r in got} and {r["source"] for r in got} == {"big.example"}
    rates = T.truncation_rates(df).where("field_name = 'primary_prompt_text'").collect()
    assert len(rates) == 1 and rates[0]["n_values"] == 200
    assert found(spark, []) == set() and T.truncation_rates(df.limit(0)).collect() == []


def test_measures(spark):
    from pyspark.sql import functions as F

    t = 'a&"é\n<🙂'
    got = spark.createDataFrame([(t,)], "t string").select(*[c.alias(k) for k, c in T.measures(F.col("t")).items()]).first().asDict()
    import html
    import json

    assert got["code_points"] == len(t) and got["utf8_bytes"] == len(t.encode()) and got["utf16_units"] == len(t.encode("utf-16-le")) // 2
    assert got["json_escaped"] == len(json.dumps(t)) - 2 and got["json_utf8_bytes"] == len(json.dumps(t, ensure_ascii=False).encode()) - 2
    assert got["html_escaped"] == len(html.escape(t)) and got["html_escaped_bytes"] == len(html.escape(t).encode())
    assert got["crlf"] == len(t.replace("\n", "\r\n")) and got["crlf_bytes"] == len(t.encode().replace(b"\n", b"\r\n"))


def _at_length(n, length, tail="", stop=False):
    """Addresses of one length with prompts of their own, cut there unless ``stop``."""
    rnd, out = random.Random(7), []
    while len(out) < n:
        words = "é" * rnd.randint(0, 9) + " " + " ".join("".join(rnd.choices("bcdfgklmnprst", k=rnd.randint(3, 8))) for _ in range(60))
        if stop:
            fit = [t for k in range(20, len(words)) if len(url(t := words[:k] + ".", tail)) == length]
            out += fit[:1]
        else:
            whole = url(words)
            u = whole[: length - len(tail)] + tail
            if re.search(r"%[0-9A-F]?$", whole[: length - len(tail)]) is None:
                out.append(u)
    return out


def test_limit_of_the_address_shows_in_the_text_taken_from_it(spark):
    """The stored text equals the prompt of the cut address; the length alone tells."""
    prompts = lambda us: [(u, T.prompt_of(u)[0]) for u in us]
    cut, tailed, whole = _at_length(9, 256), _at_length(9, 300, "&ref=1a|2"), _at_length(9, 320, stop=True)
    copied = _at_length(1, 280) * 9
    rows = [(100 * k + i, f"l{k}.example", u, t, None, None) for k, us in enumerate([cut, tailed, whole, copied], 1) for i, (u, t) in enumerate(prompts(us))]
    # Here the texts were shortened first: all addresses have one length because only spaces are written otherwise.
    rnd = random.Random(3)
    short = ["".join(rnd.choices("bcdfgklm", k=90)) for _ in range(9)]
    rows += [(500 + i, "l5.example", url(t), t, None, None) for i, t in enumerate(short)]
    got = found(spark, rows)
    assert {c for c in got if c[0] < 200} == {(100 + i, f) for i in range(9) for f in T.FIELDS}
    assert {c[0] for c in got if c[1] == "target_url" and c[0] >= 200} == {200 + i for i in range(9)}
    assert not [c for c in got if c[0] >= 300 and c[1] == "target_url"]


def test_few_values_expose_a_limit_and_the_ends_confirm_it(spark):
    """A few open addresses of one length are a limit if they break off in the middle, none if both end where texts end."""
    whole = [t for t in (r[3].rstrip(".") for r in corpus()) if t]
    rows = corpus() + [(1 + i, "few.example", u, T.prompt_of(u)[0], None, None) for i, u in enumerate(_at_length(4, 256))]
    same = next((a, b) for a in whole for b in whole if a != b and len(url(a)) == len(url(b)))
    rows += [(11 + i, "chance.example", url(t), t, None, None) for i, t in enumerate(same)]
    got = found(spark, rows)
    assert {(i, "target_url") for i in range(1, 5)} <= got and not [c for c in got if c[0] in (11, 12)]


def test_sources_together_expose_a_limit(spark):
    rnd = random.Random(4)
    rows = [(i, f"one{i}.example", None, "".join(rnd.choices("bcdfgklm ", k=rnd.randint(60, 140))), None, None) for i in range(300)]
    rows += [(1000 + i, f"two{i}.example", None, "".join(rnd.choices("bcdfgklm", k=100)), None, None) for i in range(40)]
    limits = T.exposed_limits(spark.createDataFrame(rows, SCHEMA), "source_domain").where("source is null and field_name = 'primary_prompt_text'")
    assert {r["limit_len"] for r in limits.collect()} == {100}


def test_longer_words_against_pairs(spark):
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choices("ab", k=rnd.randint(1, 5))) for _ in range(40)})
    stats = [(c, w, rnd.randint(0, 3), rnd.randint(0, 3)) for c in ("x", "y", "") for w in [*words, "<D>"]]
    stems = [(c, w, "abba.test") for c in ("x", "y", "z") for w in ("a", "ab", "ba", "bbbbb", "abba")]
    got = T.longer_words(spark.createDataFrame(stems, "ctx string, word string, _src string"), spark.createDataFrame(stats, "ctx string, word string, closed long, goes_on long"))
    want = {}
    for c, w, s in stems:
        n = sum(a + g for k, o, a, g in stats if k == c and (s.startswith(w) and len(s) > len(w) if o == "<D>" else o.startswith(w) and o != w))
        if n:
            want[(c, w)] = n
    assert {(r["ctx"], r["word"]): r["n_longer"] for r in got.collect()} == want
