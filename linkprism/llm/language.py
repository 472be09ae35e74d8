"""Language of texts and of the segments of mixed texts (problem 3).

Method: script ranges narrow the candidates of a sentence; per-word scores of a word
model (character trigrams for unknown words) are summed under a Viterbi path over the
words, whose switching penalty is infinite inside a sentence and ``switch`` between
sentences. The word model is trained on a bounded sample of labelled rows and on
clean sample sentences; as labels may be wrong, it is refitted once on its own
sentence labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkprism.llm import lookalikes, mojibake
from linkprism.llm.common import bounded_sample, is_text

LANGS = ["en", "de", "fr", "es", "pt", "it", "nl", "pl", "ru", "ja", "zh"]
# Names of the languages (fixed values): ISO 639-1, 639-2, English and own names.
NAMES = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano castilian",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands flemish",
    "pl": "pl pol polish polski",
    "ru": "ru rus russian русский",
    "ja": "ja jpn japanese 日本語",
    "zh": "zh zho chi cmn chinese 中文 汉语 mandarin",
}
_CODE = {n: k for k, v in NAMES.items() for n in v.split()}
SAMPLE_BOUND = 20_000
SWITCH = 4.0
MIN_USES = 3

_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»’)\]]*(?=\s)|(?<=[。！？])|\n\s*\n\s*|(?<=\s)[|/](?=\s)")
_EAST = "\u3040-\u30ff\u3400-\u9fff"
_WORD = re.compile(rf"[{_EAST}]|[^\W_{_EAST}]+(?:[-.'’#][^\W_{_EAST}]+)*|#\w+")
_KANA, _HAN, _CYR = re.compile("[\u3040-\u30ff]"), re.compile("[\u3400-\u9fff]"), re.compile("[бвгджзйлпфцчшщъыьэюя]", re.I)
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
#: Letters of two scripts side by side: what look-alikes leave behind.
_SEAM = re.compile(r"[A-Za-zÀ-ɏ][\u0370-\u052f]|[\u0370-\u052f][A-Za-zÀ-ɏ]")
_LATIN_LANGS = list(range(8))


def language_of_label(label: str | None) -> str | None:
    """The language a label names in any notation; null if it names none."""
    if not label:
        return None
    s = label.strip().lower()
    return _CODE.get(s) or _CODE.get(re.split(r"[-_ (/,;]", s, maxsplit=1)[0])


def candidates(sentence: str) -> list[int]:
    """Languages that the scripts of a sentence leave open."""
    if sentence.isascii():
        return _LATIN_LANGS if _LATIN.search(sentence) else []
    if _KANA.search(sentence):
        return [LANGS.index("ja")]
    if _HAN.search(sentence) and len(_HAN.findall(sentence)) * 4 >= len(_LATIN.findall(sentence)):
        return [LANGS.index("zh"), LANGS.index("ja")]
    if _CYR.search(sentence) and len(_CYR.findall(sentence)) * 4 >= len(_LATIN.findall(sentence)):
        return [LANGS.index("ru")]
    return _LATIN_LANGS if _LATIN.search(sentence) else []


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SENTENCE.split(text)) if s]


def words(sentence: str) -> list[str]:
    """Lower-case words and single East Asian characters; hosts, tags and numbers are left out."""
    return [w for w in _WORD.findall(sentence.lower()) if "." not in w and "#" not in w and not w.isdigit()]


def _clean(text: str) -> str:
    """Folded, with imitated letters of mixed tokens undone where the whole token converts."""
    if text.isascii():
        return text
    text = lookalikes.fold(text)
    if not _SEAM.search(text):
        return text
    options = lookalikes.repairs(text)
    return lookalikes.substitute(text, {k: v[-1] if len(v) > 1 and not _CYR.search(v[0]) else v[0] for k, v in options.items()}) if options else text


@dataclass
class LanguageModel:
    index: dict[str, int]
    logp: np.ndarray  # rows: words, last row: zeros for unknown words; columns: LANGS
    grams: dict[str, np.ndarray]
    garbled: mojibake.GarbleModel | None = None
    switch: float = SWITCH

    def unknown(self, word: str) -> np.ndarray:
        """Character trigrams of a word that the word model lacks, at most a few nats."""
        got = [g for i in range(len(word)) if (g := self.grams.get(f" {word} "[i : i + 3])) is not None]
        if len(got) < 2:
            return np.zeros(len(LANGS))
        s = np.mean(got, axis=0)
        return np.maximum(s - s.max(), -1.5)

    def sentence_scores(self, sents: list[str], cache: dict[str, np.ndarray]) -> np.ndarray:
        """Scores of many sentences; each distinct sentence is scored once while it is in the cache."""
        if len(cache) > 100_000:
            cache.clear()
        new = [s for s in dict.fromkeys(sents) if s not in cache]
        if new:
            cache.update(zip(new, self._scores(new)))
        return np.array([cache[s] for s in sents])

    def _scores(self, sents: list[str]) -> np.ndarray:
        """Log scores of distinct sentences at once, -1e4 for languages the script rules out; no letters: all 0."""
        cache: dict[str, np.ndarray] = {}
        rows, ids, extra = [], [], []
        for i, s in enumerate(sents):
            for w in words(s):
                k = self.index.get(w)
                if k is not None:
                    rows.append(i)
                    ids.append(k)
                elif len(w) > 2:
                    v = cache.get(w)
                    if v is None:
                        v = cache[w] = self.unknown(w)
                    extra.append((i, v))
        out = np.zeros((len(sents), len(LANGS)))
        if rows:
            r = np.asarray(rows)
            starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            out[r[starts]] = np.add.reduceat(self.logp[ids], starts, axis=0)
        for i, v in extra:
            out[i] += v
        for i, s in enumerate(sents):
            c = candidates(s)
            if len(c) == 1 or c and out[i].any():
                keep = out[i, c]
                out[i] = -1e4
                out[i, c] = keep
            else:  # names, numbers and hosts say nothing
                out[i] = 0
        return out

    def path(self, scores: np.ndarray) -> list[int]:
        """Viterbi over sentences; ties go to staying, then to the earlier language of LANGS."""
        best, back = scores[0].copy(), []
        for row in scores[1:]:
            jump = int(best.argmax())
            move = best[jump] - self.switch
            stay = best >= move
            back.append(np.where(stay, np.arange(len(LANGS)), jump))
            best = np.where(stay, best, move) + row
        k = int(best.argmax())
        out = [k]
        for b in reversed(back):
            k = int(b[k])
            out.append(k)
        return out[::-1]

    def segments(self, texts: list[str], cache: dict[str, np.ndarray], tokens: dict[str, list]) -> list[list[tuple[str, float, str]]]:
        """Per text its segments (language, confidence, text); none where no sentence shows a language."""
        fixed = []
        for t in texts:
            if self.garbled is not None and not t.isascii():
                if len(tokens) > 200_000:
                    tokens.clear()
                chain, back = self.garbled.decide(t, tokens)
                t = back or t
            fixed.append(_clean(t))
        split = [sentences(t) for t in fixed]
        flat = [s for ss in split for s in ss]
        if not flat:
            return [[] for _ in texts]
        scores = self.sentence_scores(flat, cache)
        out, at = [], 0
        for ss in split:
            own = scores[at : at + len(ss)]
            at += len(ss)
            tops = own.argmax(axis=1)[own.any(axis=1)]
            if not len(tops):
                out.append([])
                continue
            path = [int(tops[0])] * len(own) if (tops == tops[0]).all() else self.path(own)
            segs, i = [], 0
            while i < len(path):
                j = i
                while j < len(path) and path[j] == path[i]:
                    j += 1
                s = own[i:j].sum(axis=0)
                p = np.exp(s - s.max())
                segs.append((LANGS[path[i]], round(float(p[path[i]] / p.sum()), 4), " ".join(ss[i:j])))
                i = j
            out.append(segs)
        return out


def _fit_once(pairs: Iterable[tuple[list[str], int, float]], min_uses: int) -> LanguageModel:
    counts: dict[str, np.ndarray] = {}
    uses: Counter[str] = Counter()
    for ws, lang, weight in pairs:
        for w in set(ws):
            uses[w] += 1 if weight == 1 else min_uses
        for w in ws:
            c = counts.get(w)
            if c is None:
                c = counts[w] = np.zeros(len(LANGS))
            c[lang] += weight
    kept = [w for w in counts if uses[w] >= min_uses]
    m = np.array([counts[w] for w in kept]) if kept else np.zeros((0, len(LANGS)))
    p = (m + 0.05) / (m.sum(axis=0) + 0.05 * max(1, len(kept)) + 20)
    logp = np.where(m.sum(axis=0) > 0, np.log(p), -50.0)  # a language without training text is never chosen
    logp -= logp.max(axis=1, keepdims=True) if len(kept) else 0
    grams: dict[str, np.ndarray] = {}
    for w, row in zip(kept, m):
        for i in range(len(w)):
            g = grams.setdefault(f" {w} "[i : i + 3], np.zeros(len(LANGS)))
            g += row > 0.5 * row.max()
    total = sum(grams.values()) if grams else np.ones(len(LANGS))
    grams = {g: np.log((v + 0.2) / (total + 0.2 * len(grams))) for g, v in grams.items()}
    return LanguageModel({w: i for i, w in enumerate(kept)}, np.maximum(logp, -8.0), grams)


def fit(labelled: list[tuple[str, str]], seeds: list[tuple[str, str]], min_uses: int = MIN_USES) -> LanguageModel:
    """Fit on (text, language) pairs that may be wrong and on clean (text, language) seeds."""
    clean = [(words(s), LANGS.index(k), 3.0) for t, k in seeds if k in LANGS for s in sentences(t)]
    texts = [(_clean(t), LANGS.index(k)) for t, k in labelled if k in LANGS]
    parts = [[(s, words(s)) for s in dict.fromkeys(sentences(t))] for t, _ in texts]  # repeats inside a text count once
    model = _fit_once([*((w, k, 1.0) for (_, k), ss in zip(texts, parts) for _, w in ss), *clean], min_uses)
    cache: dict[str, np.ndarray] = {}
    flat = [s for ss in parts for s, _ in ss]
    own = model.sentence_scores(flat, cache).argmax(axis=1) if flat else []
    again = [(w, int(k), 1.0) for (w, k) in zip((w for ss in parts for _, w in ss), own)]
    return _fit_once([*again, *clean], min_uses)


def fit_from(df: DataFrame, text: str, label: str, keys: list[str], seeds: DataFrame, bound: int = SAMPLE_BOUND, garbled: mojibake.GarbleModel | None = None) -> LanguageModel:
    """Fit on at most ``bound`` labelled rows (the bound of the training sample) and the seed sentences (a fixed small table)."""
    pool = df.where(is_text(F.col(text)) & F.col(label).isNotNull())
    rows = bounded_sample(pool, keys, bound).select(text, label).collect()
    pairs = sorted({(t, k) for t, x in rows if (k := language_of_label(x))})
    model = fit(pairs, [(r["text"], r["lang"]) for r in seeds.where("text is not null").select("text", "lang").collect()])
    model.garbled = garbled
    return model


def segmented(df: DataFrame, text: str, model: LanguageModel) -> DataFrame:
    """``df`` with ``segments`` array<struct<segment_no, lang, confidence, segment>>; null, empty and blank texts get an empty array."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    @F.pandas_udf("array<struct<segment_no:int,lang:string,confidence:double,segment:string>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, cache, tokens = shared.value, {}, {}
        for s in batches:
            distinct = list(dict.fromkeys(t for t in s if t and not t.isspace()))
            found = dict(zip(distinct, m.segments(distinct, cache, tokens)))
            yield pd.Series([[(i, *x) for i, x in enumerate(found.get(t, ()), 1)] for t in s], dtype=object)

    return df.withColumn("segments", cut(F.col(text)))


def label_language(c) -> object:
    """Language that a label names, as an expression; null if none."""
    clean = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    names = F.create_map(*[F.lit(x) for kv in sorted(_CODE.items()) for x in kv])
    return F.coalesce(F.try_element_at(names, clean), F.try_element_at(names, F.regexp_extract(clean, r"^([^-_ (/,;]+)", 1)))


def relabelled(links: DataFrame, seeds: DataFrame, bound: int = SAMPLE_BOUND) -> DataFrame:
    """(row_id, segment_no, lang, confidence, segment, is_case) for every row with a language.

    ``is_case``: the text mixes languages, or its label is missing or names another.
    """
    texts = links.select("row_id", F.col("primary_prompt_text").alias("text"), "prompt_lang").where(is_text(F.col("text")))
    model = fit_from(texts, "text", "prompt_lang", ["row_id"], seeds, bound)
    fixed = mojibake.repaired(texts, "text", ["row_id"]).withColumn("text", F.coalesce(F.when(F.col("restored_text") != "", F.col("restored_text")), "text")).drop("garble_chain", "restored_text")
    found = segmented(fixed, "text", model).where(F.size("segments") > 0)
    right = (F.size("segments") == 1) & F.coalesce(label_language(F.col("prompt_lang")) == F.col("segments")[0]["lang"], F.lit(False))
    return found.select("row_id", (~right).alias("is_case"), F.explode("segments").alias("s")).select("row_id", "s.*", "is_case")
