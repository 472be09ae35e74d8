"""Values that lost their end before they were stored (problem 1).

Method: the length of every value is recomputed under several encodings (code points,
UTF-8, UTF-16, HTML entities, JSON escapes, CRLF line ends); grouped by source, each
measure's histogram of different values exposes hidden storage limits as significant
spikes, and so do the sources' longest values taken together. A value at a limit of
its source is cut unless its end shows that it is whole. Then the other endings are
inspected: damaged escapes and characters, a continuation in the other field, and how
the corpus goes on after the last words. Statistics cover all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkprism.llm.common import is_text
from linkprism.operators.rules import PROMPT_KEYS
from linkprism.runtime import staged

FIELDS = ("primary_prompt_text", "target_url")
#: A spike is a length that so many different values would share by chance less often than this, over all lengths of a source.
SPIKE_CHANCE = 0.01
#: Lengths on either side that tell how many values to expect.
SPIKE_REACH = 6
#: Endings that the corpus closes in at most this share of the cases count as cut.
CLOSED_SHARE = 0.04

_TERMINAL = set(".!?。！？)）]」』”»\"“")
_STOP = re.compile(r"[.!?。！？;；:：]+")
_EAST = "\u3040-\u30ff\u3400-\u9fff"
_TOKEN = re.compile(rf"[{_EAST}]|[^\W_{_EAST}]+(?:[-.'’][^\W_{_EAST}]+)*|[.!?。！？]+|[#@(\[“„«\"]")
_PARTIAL = re.compile(r"%[0-9A-Fa-f]?$")
_HOST = re.compile(r"[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}$")
_DOTS = re.compile(r"\s*(?:\.\.\.|…)$")


MEASURES = ("code_points", "utf8_bytes", "utf16_units", "html_escaped", "html_escaped_bytes", "json_escaped", "json_utf8_bytes", "crlf", "crlf_bytes")


def measures(c: Column) -> dict[str, Column]:
    """Length of a value as different stores count it; counts of single signs, so no copy of the value is escaped."""
    n, b = F.length(c), F.octet_length(c)

    def uses(sign: str) -> Column:
        return b - F.octet_length(F.replace(c, F.lit(sign), F.lit("")))

    units = F.octet_length(F.encode(c, "UTF-16LE")).cast("int")
    units = F.when(n == b, n).otherwise(F.shiftright(units, 1))
    other = F.when(n == b, F.lit(0)).otherwise(F.length(F.regexp_replace(c, r"[\x00-\x7f]+", "")))
    html = 4 * uses("&") + 3 * (uses("<") + uses(">")) + 5 * (uses('"') + uses("'"))
    json = uses('"') + uses("\\") + uses("\n") + uses("\r") + uses("\t")
    ends = uses("\n") - F.shiftright(uses("\r\n"), 1)
    found = (n, b, units, n + html, b + html, n + json + 5 * other + 6 * (units - n), b + json, n + ends, b + ends)
    return dict(zip(MEASURES, found))


def source_key(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)), F.lit(""))


def _rarely(n: Column, expected: Column, tests: Column) -> Column:
    """Whether ``n`` values where ``expected`` are expected is rarer than SPIKE_CHANCE in so many tests (Chernoff bound of the Poisson tail)."""
    return (n > expected) & (n - expected + n * F.log(expected / n) < F.log(F.lit(SPIKE_CHANCE) / tests))


def length_histogram(values: DataFrame) -> DataFrame:
    """(field_name, source, len, some, n0..n8, m0..m8) from (field_name, source, value_id, open, lens): different open values by length and measure.

    ``some`` tells that a value, open or not, has so many code points, ``m`` that the
    length is the source's largest in the measure. A value whose measures agree is one
    row; counts merge on the map side.
    """
    distinct = values.groupBy("field_name", "source", "value_id").agg(F.max("open").alias("open"), F.first("lens").alias("lens"))
    k = range(len(MEASURES))
    each = distinct.select("field_name", "source", "open", "lens", F.explode(F.array_distinct("lens")).alias("len"))
    counts = each.groupBy("field_name", "source", "len").agg(
        *[F.count_if(F.col("open") & (F.col("lens")[i] == F.col("len"))).alias(f"n{i}") for i in k], *[F.max((F.col("lens")[i] == F.col("len"))).alias(f"a{i}") for i in k]
    )
    whole = Window.partitionBy("field_name", "source")
    return counts.select("field_name", "source", "len", F.col("a0").alias("some"), *[f"n{i}" for i in k], *[(F.col(f"a{i}") & (F.col("len") == F.max(F.when(F.col(f"a{i}"), F.col("len"))).over(whole))).alias(f"m{i}") for i in k])


def spikes(hist: DataFrame) -> DataFrame:
    """(field_name, source, measure, limit_len, n_values, expected): limits that the histograms expose.

    Source null: a limit of all sources together, where more of them than by chance
    have an open value of this length as their longest. ``expected`` is the mean of the
    lengths around, for a source at least what the spread of all lengths lets expect.
    """
    k = range(len(MEASURES))
    filled = hist.select("field_name", "len", *[(F.col(f"m{i}") & (F.col(f"n{i}") > 0)).cast("int").alias(f"n{i}") for i in k], F.col("some").cast("int").alias("any"))
    pooled = filled.groupBy("field_name", "len").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in k], F.sum("any").alias("any"))
    # The chance that two values of different sources have one length; a source's own spike counts once.
    spread = pooled.groupBy("field_name").agg((F.sum(F.col("any") * F.col("any")) / F.pow(F.sum("any"), F.lit(2.0))).alias("_together"))

    def found(h: DataFrame, keys: list[str], together: Column, least: float) -> DataFrame:
        near, whole = Window.partitionBy(*keys).orderBy("len").rangeBetween(-SPIKE_REACH, SPIKE_REACH), Window.partitionBy(*keys)
        cols = [F.struct(F.lit(MEASURES[i]).alias("measure"), F.col(f"n{i}").alias("n_values"), ((F.sum(f"n{i}").over(near) - F.col(f"n{i}")) / (2.0 * SPIKE_REACH)).alias("around"), F.count_if(F.col(f"n{i}") > 0).over(whole).alias("tests"), F.sum(f"n{i}").over(whole).alias("total")) for i in k]
        x = h.select(*keys, "len", F.array(*cols).alias("x")).select(*keys, "len", F.explode("x").alias("x")).select(*keys, "len", "x.*").where("n_values > 1")
        expected = F.greatest(F.col("around"), F.col("total") * together, F.lit(least))
        return x.withColumn("expected", expected).where(_rarely(F.col("n_values"), F.col("expected"), F.col("tests"))).select(*keys, "measure", F.col("len").alias("limit_len"), "n_values", "expected")

    own = found(hist.join(F.broadcast(spread), "field_name"), ["field_name", "source", "_together"], F.col("_together"), 1e-6).drop("_together")  # one row a field
    common = found(pooled, ["field_name"], F.lit(0.0), 0.5).withColumn("source", F.lit(None).cast("string"))
    # A limit in one measure shows in others through values that both count alike: the strongest measure stays.
    best = Window.partitionBy("field_name", "source", "limit_len")
    both = own.unionByName(common).withColumn("_m", F.max("n_values").over(best)).where(F.col("n_values") >= 0.9 * F.col("_m"))
    return both.select("field_name", "source", "measure", "limit_len", "n_values", "expected")


def prompt_of(url: str, keys: frozenset[str] = frozenset(PROMPT_KEYS)) -> tuple[str | None, bool, str]:
    """(decoded prompt, whether the address ends inside it, raw value)."""
    q = url.find("?")
    if q < 0:
        return None, False, ""
    at = q + 1
    for part in url[q + 1 :].split("&"):
        k, eq, v = part.partition("=")
        if eq and k.lower() in keys:
            return unquote_plus(v, errors="replace"), at + len(part) == len(url), v
        at += len(part) + 1
    return None, False, ""


def tokens_of(text: str, source: str) -> list[str]:
    """Words, single East Asian characters and stops; the site's own name in any form becomes <D>."""
    labels = source.split(".")
    names = {source, *(".".join(labels[i:]) for i in range(len(labels) - 1)), *labels[-2:-1]} if source else set()
    out = []
    for t in _TOKEN.findall(text):
        low = t.lower()
        if _STOP.fullmatch(t):
            out.append("<.>")
        elif low in names or _HOST.match(low):
            out.append("<D>")
        else:
            out.append(t)
    return out


def shape(tokens: list[str]) -> list[str]:
    """Capitalised words inside a sentence become <N>."""
    return ["<N>" if t[0].isupper() and i and tokens[i - 1] != "<.>" else t for i, t in enumerate(tokens)]


def _key(tokens: list[str], kind: str) -> str:
    return "\x1f".join([kind, *(["<^>", "<^>", *tokens][-3:])])


def endings_of(text: str, source: str) -> tuple[str, str, str, str]:
    """(literal key, shape key, context of the last word, last word) of an open ending."""
    toks = tokens_of(text, source)
    if not toks:
        return "", "", "", ""
    return _key(toks, "L"), _key(shape(toks), "S"), "\x1f".join(["<^>", "<^>", *toks][-3:-1]), toks[-1]


def followers(text: str, source: str) -> Iterator[tuple[str, str, str, int, int, int]]:
    """(key, context, last word, closed, open end, goes on) for each position of a text."""
    toks = tokens_of(text, source)
    for kind, seq in (("L", toks), ("S", shape(toks))):
        for i, t in enumerate(seq):
            if t == "<.>":
                continue
            ctx = ["<^>", "<^>", *seq][i : i + 2]
            nxt = seq[i + 1] if i + 1 < len(seq) else None
            yield "\x1f".join([kind, *ctx, t]), "\x1f".join(ctx) if kind == "L" else "", t, int(nxt == "<.>"), int(nxt is None), int(nxt not in (None, "<.>"))


def _more(short: str, long: str) -> bool:
    """``long`` goes on with a letter or digit where ``short`` ends."""
    return len(long) > len(short) and long.startswith(short) and any(x.isalnum() for x in long[len(short) :])


def inspect(text: str | None, url: str | None, source: str, keys: frozenset[str] = frozenset(PROMPT_KEYS)) -> dict:
    """What the two values of a row show by themselves; see ``cut_values`` for the verdict."""
    out = dict(text_cut=False, text_open=False, text_known=False, url_cut=False, url_open=False, url_same=False, url_whole=False, tk=None, ts=None, tc=None, tw=None, uk=None, us=None, uc=None, uw=None)
    t = text if text and text.strip() else None
    u = url if url and url.strip() else None
    prompt, last, raw = prompt_of(u, keys) if u else (None, False, "")
    bare = t and re.sub(r"�+$", "", _DOTS.sub("", t.rstrip())) or None
    p = None
    if prompt is not None:
        p = re.sub(r"�+$", "", re.sub(r"%[0-9A-Fa-f]?$", "", prompt) if _PARTIAL.search(raw) else prompt)
        damaged = last and bool(_PARTIAL.search(raw) or prompt.endswith("�") and not (t and t.endswith("�") and p == bare))
        if damaged:
            out["url_cut"] = True
        if last and t and _more(p, bare):
            out["url_cut"] = True
        if t and _more(bare, p):
            out["text_cut"] = True
    if u:
        if _PARTIAL.search(u):
            out["url_cut"] = True
        tail = u.rpartition("&")[2] if "&" in u else ""
        if prompt is not None and not last and tail:
            k, eq, v = tail.partition("=")
            if not eq or (len(v) > 2 and v.lower() != source and source.startswith(v.lower())):
                out["url_cut"] = True
            out["url_whole"] = bool(source) and v.lower() == source
        elif last and not out["url_cut"]:
            out["url_whole"] = prompt[-1:] in _TERMINAL
    if t:
        out["text_known"] = p is not None and (prompt.rstrip() == t.rstrip() or p.rstrip() == (bare or "").rstrip())  # the address carries the same prompt
        if t.endswith("�"):
            out["text_cut"] = True
        elif _DOTS.search(t.rstrip()) or t.rstrip()[-1] not in _TERMINAL:
            out["text_open"] = True
            last_word = re.split(r"\s", bare)[-1].lower() if bare else ""
            if source and len(last_word) > 3 and "." in last_word and source != last_word and source.startswith(last_word):
                out["text_cut"] = True
            out["tk"], out["ts"], out["tc"], out["tw"] = endings_of(bare or "", source)
    out["url_same"] = bool(t and last and out["text_known"])
    if p and last and p.strip() and p.rstrip()[-1] not in _TERMINAL:
        out["uk"], out["us"], out["uc"], out["uw"] = endings_of(p, source)
    if out["uk"] is not None and not out["url_same"]:
        out["url_open"] = True
        last_word = re.split(r"\s", p.rstrip())[-1].lower()
        if source and len(last_word) > 3 and "." in last_word and source != last_word and source.startswith(last_word):
            out["url_cut"] = True
    return out


_FEATURES = "text_cut boolean, text_open boolean, text_known boolean, url_cut boolean, url_open boolean, url_same boolean, url_whole boolean, tk string, ts string, tc string, tw string, uk string, us string, uc string, uw string"


def _closed(stats: DataFrame, rows: DataFrame, key: str, out: str) -> DataFrame:
    s = stats.where(F.col("key") != "").select(F.col("key").alias(key), F.struct("closed", "open_end", "goes_on").alias(out))
    return rows.join(s, key, "left")


def longer_words(stems: DataFrame, stats: DataFrame) -> DataFrame:
    """(ctx, word, _src, n_longer): how often the corpus has, after ``ctx``, a word that goes on behind ``word``.

    The words of a context are sorted once and summed up; what goes on behind a stem is
    the difference of the sums at the ends of its range, so no stem meets a word in a
    pair. A site's own name stands as <D> and is looked up by itself.
    """
    asked = stems.select("ctx").distinct()
    words = stats.where("ctx <> ''").join(asked, "ctx", "left_semi").select("ctx", "word", (F.col("closed") + F.col("goes_on")).alias("n"))
    plain = words.where("word <> '<D>'").groupBy("ctx", "word").agg(F.sum("n").alias("n"))
    ends = stems.select("ctx", "word").distinct().select("ctx", "word", F.explode(F.array(F.struct(F.col("word").alias("at"), F.lit(-1).alias("sign")), F.struct(F.concat("word", F.lit("\U0010ffff")).alias("at"), F.lit(1).alias("sign")))).alias("x"))
    line = plain.select("ctx", F.col("word").alias("at"), "n", F.lit(None).cast("string").alias("word"), F.lit(0).alias("sign")).unionByName(ends.select("ctx", "x.at", F.lit(0).cast("long").alias("n"), "word", "x.sign"))
    upto = Window.partitionBy("ctx").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = line.withColumn("_c", F.sum("n").over(upto)).where("sign <> 0").groupBy("ctx", "word").agg(F.sum(F.col("_c") * F.col("sign")).alias("n_plain"))
    own = words.where("word = '<D>'").groupBy("ctx").agg(F.sum("n").alias("n_own"))
    inside = F.col("_src").startswith(F.lower("word")) & (F.length("_src") > F.length("word"))
    both = stems.join(sums, ["ctx", "word"], "left").join(own, "ctx", "left")
    total = F.coalesce("n_plain", F.lit(0)) + F.when(inside, F.coalesce("n_own", F.lit(0))).otherwise(0)
    return both.select("ctx", "word", "_src", total.alias("n_longer")).where("n_longer > 0")


def _looked(df: DataFrame, source: str, row_id: str, keys: list[str]) -> DataFrame:
    """The values' features and lengths, one row per row; the values themselves stay behind."""
    known = frozenset(k.lower() for k in keys)

    @F.pandas_udf(_FEATURES)
    def look(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for t, u, s in batches:
            yield pd.DataFrame([inspect(a, b, c, known) for a, b, c in zip(t, u, s)])

    base = df.select(F.col(row_id).alias("_id"), source_key(F.col(source)).alias("_src"), *[F.col(f) for f in FIELDS])
    lens = [F.when(is_text(F.col(f)), F.array(*measures(F.col(f)).values())).alias(f"_n_{f}") for f in FIELDS]
    ids = [F.xxhash64(f).alias(f"_h_{f}") for f in FIELDS]
    return staged(base.withColumn("_f", look(FIELDS[0], FIELDS[1], "_src")).select("_id", "_src", "_f.*", *lens, *ids), "looked")


def _by_length(seen: DataFrame) -> DataFrame:
    opened = {FIELDS[0]: F.col("text_open"), FIELDS[1]: ~F.col("url_whole")}
    parts = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"_h_{f}").alias("value_id"), opened[f].alias("open"), F.col(f"_n_{f}").alias("lens")) for f in FIELDS])
    return seen.select(F.col("_src").alias("source"), F.explode(parts).alias("x")).select("source", "x.*").where("lens is not null")


def exposed_limits(df: DataFrame, source: str, keys: list[str] = PROMPT_KEYS) -> DataFrame:
    """(field_name, source, measure, limit_len, n_values, expected) of each exposed limit, see ``spikes``.

    Blank and null values are left out; a null source is a source of its own, named ''.
    Repeated values count once, values whose end shows that they are whole not at all.
    """
    return spikes(length_histogram(_by_length(_looked(df.withColumn("__lp_row", F.lit(0)), source, "__lp_row", keys))))


def _at_limits(seen: DataFrame, hist: DataFrame) -> DataFrame:
    """``seen`` with ``text_at``, ``url_at`` (n, len, i: the strongest limit of its source that the value has, or null) and ``text_common``, ``url_common``."""
    limits = staged(spikes(hist), "limits")
    lists = [F.collect_list(F.when(F.col("field_name") == f, F.struct(F.col("n_values").alias("n"), F.col("limit_len").alias("len"), F.array_position(F.array(*[F.lit(m) for m in MEASURES]), F.col("measure")).cast("int").alias("i")))) for f in FIELDS]
    per = limits.where("source is not null").groupBy(F.col("source").alias("_src")).agg(lists[0].alias("_l0"), lists[1].alias("_l1"))
    common = limits.where("source is null").agg(lists[0].alias("_c0"), lists[1].alias("_c1"))  # one row; lengths that many sources share
    tops = hist.groupBy(F.col("source").alias("_src")).agg(*[F.array(*[F.max(F.when((F.col("field_name") == f) & F.col(f"m{i}"), F.col("len"))) for i in range(len(MEASURES))]).alias(f"_t{j}") for j, f in enumerate(FIELDS)])
    at = seen.join(tops, "_src", "left").join(per, "_src", "left").crossJoin(F.broadcast(common))

    def strongest(lens: Column, known: str) -> Column:
        return F.array_max(F.filter(known, lambda x: F.element_at(lens, x["i"]) == x["len"]))

    def is_common(lens: Column, top: Column, known: str) -> Column:
        return F.coalesce(F.exists(known, lambda x: (F.element_at(lens, x["i"]) == x["len"]) & (F.element_at(top, x["i"]) == x["len"])), F.lit(False))

    new = {}
    for j, (f, name) in enumerate(zip(FIELDS, ("text", "url"))):
        lens = F.col(f"_n_{f}")
        new |= {f"{name}_at": strongest(lens, f"_l{j}"), f"{name}_common": is_common(lens, F.col(f"_t{j}"), f"_c{j}"), f"has_{name}": lens.isNotNull()}
    return at.withColumns(new).drop(*[f"_{k}{j}" for k in "lct" for j in (0, 1)], *[f"_{k}_{f}" for k in "nh" for f in FIELDS])


def cut_values(df: DataFrame, source: str = "source_domain", row_id: str = "link_no", keys: list[str] = PROMPT_KEYS) -> DataFrame:
    """(row_id, source, field_name, limit) of each value that lost its end.

    A value is a case if (a) its length is an exposed limit of its source, nothing shows
    that it is whole and most values there break off in the middle; or (b) its last escape or character is damaged, the other
    field of the row holds its continuation, or it ends inside the site's own name; or
    (c) its ending is open and the corpus goes on after its last three words but hardly
    ever closes there, or knows its last word only as the start of longer ones; or (d)
    it is the longest of its source at a limit that many sources share, or stands at
    another limit of its source, its end is open and the corpus does not tell. A text that ends with a stop is whole at a limit if
    the address carries it. An address with the prompt of a text at a limit that holds
    as many values is whole: there the text was shortened first. A text equal to the
    prompt of an address at its own limit was taken from it and is a case with it.
    Null, empty and blank values are never cases. ``limit`` is true for values at a
    limit, ``keys`` are the query keys that carry a prompt.
    """
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total: dict[tuple[str, str, str], list[int]] = {}
            for t, s in zip(pdf["t"], pdf["_src"]):
                for k, c, w, a, b, g in followers(t, s):
                    x = total.setdefault((k, c, w), [0, 0, 0])
                    x[0] += a
                    x[1] += b
                    x[2] += g
            yield pd.DataFrame([(*k, *v) for k, v in total.items()], columns=["key", "ctx", "word", "closed", "open_end", "goes_on"])

    bare = F.regexp_replace(F.col(FIELDS[0]), r"\s*(?:\.\.\.|\x{2026}|\x{fffd})+\s*$", "")
    distinct = df.where(is_text(F.col(FIELDS[0]))).groupBy(bare.alias("t")).agg(F.min(source_key(F.col(source))).alias("_src"))
    stats = (
        distinct.mapInPandas(spread, "key string, ctx string, word string, closed long, open_end long, goes_on long")
        .groupBy("key", "ctx", "word")
        .agg(F.sum("closed").alias("closed"), F.sum("open_end").alias("open_end"), F.sum("goes_on").alias("goes_on"))
    )
    stats = staged(stats, "endings")
    seen = _looked(df, source, row_id, keys)
    at = _at_limits(seen, staged(length_histogram(_by_length(seen)), "lengths"))
    shortened = F.col("text_known") & F.coalesce(F.col("text_at.n") >= F.col("url_at.n"), F.lit(False))
    url_limit = F.col("url_at").isNotNull() & ~F.col("url_whole") & ~shortened
    text_limit = F.col("text_at").isNotNull() & (F.col("text_open") | ~F.col("text_known"))
    taken = url_limit & F.col("url_same") & F.col("text_open")

    # One long table of values, so each statistic is joined once.
    columns = {
        FIELDS[0]: {"cut": F.col("text_cut"), "at": F.when(text_limit, F.concat(F.lit("t"), F.col("text_at.len").cast("string"))).when(taken, F.concat(F.lit("u"), F.col("url_at.len").cast("string"))), "open": F.col("text_open"), "common": F.col("text_common"), "limit": F.col("text_at").isNotNull() | F.col("text_common"), "lk": F.col("tk"), "sk": F.col("ts"), "ctx": F.col("tc"), "word": F.col("tw"), "has": F.col("has_text")},
        FIELDS[1]: {"cut": F.col("url_cut"), "at": F.when(url_limit, F.concat(F.lit("u"), F.col("url_at.len").cast("string"))), "open": F.col("url_open"), "common": F.col("url_common"), "limit": F.col("url_at").isNotNull() | F.col("url_common"), "lk": F.col("uk"), "sk": F.col("us"), "ctx": F.col("uc"), "word": F.col("uw"), "has": F.col("has_url")},
    }
    both = F.array(*[F.struct(F.lit(f).alias("field_name"), *[c.alias(k) for k, c in cs.items()]) for f, cs in columns.items()])
    at = staged(at.select("_id", "_src", F.explode(both).alias("x")).select("_id", "_src", "x.*").where("has").drop("has"), "values")

    asked = at.where("(open or at is not null) and not cut and lk is not null").select("_id", "_src", "field_name", "lk", "sk", "ctx", "word")
    keyed = _closed(stats, _closed(stats, asked, "lk", "lit"), "sk", "shp")
    longer = longer_words(asked.where("word <> ''").select("ctx", "word", "_src").distinct(), stats)
    lit_n = F.coalesce(F.col("lit.closed") + F.col("lit.goes_on"), F.lit(0))
    best = F.when(lit_n >= 3, F.col("lit")).otherwise(F.coalesce(F.col("shp"), F.col("lit")))
    said = keyed.withColumn("b", best).join(longer, ["ctx", "word", "_src"], "left")
    ends = F.col("b.closed") + F.greatest(F.col("b.open_end") - 1, F.lit(0))
    verdict = (
        F.when((lit_n == 0) & (F.coalesce("n_longer", F.lit(0)) > 0), F.lit("cut"))
        .when(F.col("b.goes_on") + F.col("b.closed") > 0, F.when(ends <= CLOSED_SHARE * F.col("b.goes_on"), F.lit("cut")).otherwise(F.lit("whole")))
        .otherwise(F.lit("unknown"))
    )
    judged = said.select("_id", "field_name", verdict.alias("verdict"))
    final = staged(at.join(judged, ["_id", "field_name"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("unknown"))), "judged")
    # A limit stands if most of what it holds breaks off in the middle; values of one length by chance end where texts end.
    whole = (F.col("verdict") == "whole") & ~F.col("cut")
    stands = final.where("at is not null").groupBy("_src", "at").agg(F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("w")).where("2 * w < n").select("_src", "at", F.lit(True).alias("stands"))
    final = final.join(stands, ["_src", "at"], "left")
    near = (F.col("at").isNotNull() | (F.col("common") & F.col("open"))) & (F.col("verdict") == "unknown")
    case = F.col("stands") | F.col("cut") | (F.col("verdict") == "cut") | near
    return final.where(F.coalesce(case, F.lit(False))).select(F.col("_id").alias(row_id), F.col("_src").alias("source"), "field_name", "limit")


def truncation_rates(df: DataFrame, source: str = "source_domain", row_id: str = "link_no", keys: list[str] = PROMPT_KEYS) -> DataFrame:
    """Per source and field: values, cut values and their share; '' stands for a null source."""
    cut = cut_values(df, source, row_id, keys).groupBy("source", "field_name").agg(F.count(F.lit(1)).alias("n_cut"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), is_text(F.col(f)).alias("has")) for f in FIELDS])
    values = (
        df.select(source_key(F.col(source)).alias("source"), F.explode(pairs).alias("x"))
        .where("x.has")
        .groupBy("source", "x.field_name")
        .agg(F.count(F.lit(1)).alias("n_values"))
    )
    n = F.coalesce("n_cut", F.lit(0))
    return values.join(cut, ["source", "field_name"], "left").select("source", "field_name", "n_values", n.alias("n_cut"), (n / F.col("n_values")).alias("cut_share"))
