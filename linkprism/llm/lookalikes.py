"""One consistent form for texts that look the same (problem 5).

Method: script-aware repair. Width forms, ligatures, unusual spaces, combining accents
and invisible characters are folded by rule; then, token by token, letters that
imitate another script are substituted only where the token mixes scripts (or is a
stray word of imitations inside a text of the other script) and only if the result is
a word of the corpus vocabulary, which is counted over all texts.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkprism.llm.common import is_text
from linkprism.runtime import staged

# Letters of other scripts that imitate Latin ones (fixed values): imitation, Latin.
_TO_LATIN = dict(
    zip(
        "авсԁеһіјкӏмноԛрѕтуѵԝхꙅ" "АВСЕНІЈКӀМОРЅТУѴԜХԚԌ" "αεικνορτυχγ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ɑɡıℓ",
        "abcdehijklmhoqpstyvwxs" "ABCEHIJKlMOPSTYVWXQG" "aeikvoptuxy" "ABEZHIKMNOPTYX" "agil",
    )
)
#: Imitations of Cyrillic letters by Latin ones (fixed values); where several Cyrillic letters look alike, the common one.
_TO_CYRILLIC = dict(zip("aceopxyijskmhtABCEHIJKMOPSTXY", "асеорхуіјѕкмнтАВСЕНІЈКМОРЅТХУ"))
_GREEK = {v: k for k, v in zip("αικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aikvoptuxABEZHIKMNOPTYX")}

_AMBIGUOUS = {*_TO_LATIN, *_TO_LATIN.values(), *_TO_CYRILLIC, *_TO_CYRILLIC.values()}

_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")
_LETTERS = {"latin": r"A-Za-zªºÀ-ÖØ-öø-ɏɐ-ʯḀ-ỿℓ", "greek": r"Ͱ-Ͽἀ-῿", "cyrillic": r"Ѐ-ԯꙀ-ꚟ"}
_SCRIPT = {k: re.compile(f"[{v}]") for k, v in _LETTERS.items()}
_FOREIGN = re.compile(f"[{_LETTERS['greek']}{_LETTERS['cyrillic']}ɑɡıℓ]")
_INVISIBLE = re.compile(r"(?<![☀-➿\U0001f000-\U0001faff️])‍|‍(?![☀-➿\U0001f000-\U0001faff])|[­͏؜ᅟᅠ឴឵᠎​‌‎‏‪-‮⁠-⁤⁪-⁯ㅤ﻿ﾠ]")


@lru_cache(maxsize=1)
def _folds() -> dict[int, str]:
    """By rule: width, font and non-breaking forms and letter ligatures to their plain letters, space characters to a space."""
    table = {}
    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        if unicodedata.category(c) in ("Zs", "Zl", "Zp") or i == 0x85:
            table[i] = " "
            continue
        kind = unicodedata.decomposition(c)
        if kind.startswith("<") and kind[1:].split(">")[0] in ("wide", "narrow", "font", "noBreak", "compat"):
            plain = unicodedata.normalize("NFKC", c)
            if kind.startswith("<compat>") and not plain.isalpha():
                continue
            table[i] = plain
    return table


@lru_cache(maxsize=1)
def _foldable() -> re.Pattern[str]:
    """One character class over the table's keys, so that most texts skip the table."""
    keys, ranges = sorted(_folds()), []
    for k in keys:
        if ranges and ranges[-1][1] == k - 1:
            ranges[-1][1] = k
        else:
            ranges.append([k, k])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


def fold(text: str) -> str:
    """The rule-based part: invisible characters dropped, forms folded, accents composed."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFC", text)
    if _foldable().search(text):
        text = text.translate(_folds())
    return unicodedata.normalize("NFC", _INVISIBLE.sub("", text)) if _INVISIBLE.search(text) else unicodedata.normalize("NFC", text)


def _convert(token: str, script: str) -> str | None:
    """The token with every letter in ``script``, or null if a letter has no counterpart there."""
    out = []
    for c in unicodedata.normalize("NFD", token):
        if _SCRIPT[script].match(c) and c not in "ɑɡıℓ" or unicodedata.combining(c):
            out.append(c)
            continue
        c = _TO_LATIN.get(c, c)
        if script == "cyrillic":
            c = _TO_CYRILLIC.get(c, "")
        elif script == "greek":
            c = _GREEK.get(c, "")
        if not c or not _SCRIPT[script].match(c):
            return None
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def repairs(text: str) -> dict[str, list[str]]:
    """Candidate repairs of the tokens of a folded text, the token's dominant script first."""
    if not _FOREIGN.search(text):
        return {}
    words = list(dict.fromkeys(_WORD.findall(text)))
    # Only letters that imitate nothing tell the script of a text.
    total = {k: sum(c not in _AMBIGUOUS for c in r.findall(text)) for k, r in _SCRIPT.items()}
    main = max(total, key=total.get)
    out = {}
    for w in words:
        n = {k: len(r.findall(w)) for k, r in _SCRIPT.items()}
        have = [k for k, v in n.items() if v]
        if not have or have == [main] and not any(c in w for c in "ɑɡıℓ"):
            continue
        order = sorted(dict.fromkeys([*have, main]), key=lambda k: (-n[k], k != main))
        found = [c for k in order if (c := _convert(w, k)) and c != w]
        if found:
            out[w] = found
    return out


def substitute(text: str, mapping: dict[str, str] | None) -> str:
    return _WORD.sub(lambda m: mapping.get(m.group(), m.group()), text) if mapping else text


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """Distinct lower-case words of all texts, merged before the shuffle."""
    return df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{M}]+)"), 1)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_uses"))


def normalized(df: DataFrame, text: str, row_id: str, out: str = "normalized_text") -> DataFrame:
    """``df`` with the consistent form of ``text``; null stays null, empty and blank texts keep their ordinary spaces.

    Ordinary spaces, tabs and line breaks, case and punctuation are kept. Extra columns
    stay; ``row_id`` must be unique.
    """

    @F.pandas_udf("struct<folded:string,options:array<struct<token:string,place:int,repair:string>>>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            done = [fold(t) for t in s]
            found = [[(w, i, c) for w, cs in repairs(t).items() for i, c in enumerate(cs)] or None for t in done]
            yield pd.DataFrame({"folded": pd.Series(done, dtype=object), "options": pd.Series(found, dtype=object)})

    @F.pandas_udf("string")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, m in batches:
            yield pd.Series([a if b is None else unicodedata.normalize("NFC", substitute(a, {x["token"]: x["repair"] for x in b})) for a, b in zip(t, m)], dtype=object)

    c = F.col(text)
    odd = F.coalesce(c.rlike(r"[^\x00-\x7f]"), F.lit(False))
    # Folded once and written; only rows with candidate repairs are joined to what the vocabulary chose.
    touched = staged(df.where(odd).withColumn("__lp_b", look(c)), "folded")
    asked = touched.where("__lp_b.options is not null")
    options = asked.select(F.col(row_id).alias("__lp_id"), F.explode("__lp_b.options").alias("x")).select("__lp_id", "x.*")
    known = vocabulary(df, text).select(F.col("word").alias("_w"), "n_uses")
    chosen = (
        options.join(known, F.lower("repair") == F.col("_w"))
        .groupBy("__lp_id", "token")
        .agg(F.max(F.struct("n_uses", (-F.col("place")).alias("place"), "repair")).alias("best"))  # the better known word, then the dominant script
        .groupBy("__lp_id")
        .agg(F.collect_list(F.struct("token", F.col("best.repair").alias("repair"))).alias("__lp_map"))
    )
    plain = df.where(~odd).withColumn(out, c)
    folded = touched.where("__lp_b.options is null").withColumn(out, F.col("__lp_b.folded")).drop("__lp_b")
    mended = asked.join(chosen, F.col(row_id) == F.col("__lp_id"), "left").withColumn(out, apply("__lp_b.folded", "__lp_map")).drop("__lp_b", "__lp_id", "__lp_map")
    return plain.unionByName(folded).unionByName(mended)


def disguised(links: DataFrame, prompts: DataFrame) -> DataFrame:
    """(prompt_id, row_id): rows that look like a watched prompt but are stored in other characters.

    Ordinary white space, case and punctuation must agree. ``prompts`` is a watch list;
    the join is planned by its measured size.
    """
    @F.pandas_udf("string")
    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else fold(t) for t in s], dtype=object)

    rows = normalized(links.select("row_id", "primary_prompt_text"), "primary_prompt_text", "row_id").where(F.col("primary_prompt_text").rlike(r"[^\x00-\x7f]"))
    watch = prompts.where(is_text(F.col("prompt_text"))).select("prompt_id", "prompt_text", plain("prompt_text").alias("_k"))
    return rows.join(watch, F.col("normalized_text") == F.col("_k")).where(F.col("primary_prompt_text") != F.col("prompt_text")).select("prompt_id", "row_id").distinct()
