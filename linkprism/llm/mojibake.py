"""Text decoded with the wrong character encoding (problem 4).

Method: a multinomial classifier on hashed byte bigrams, trained on synthetically
garbled tokens of the corpus, predicts the encoding chain; the chain is inverted and
the result must decode strictly and look clean to the classifier. Decisions are made
per white-space token against one chain per text, so text that is garbled only in
part is found and only that part is changed.
"""

from __future__ import annotations

import codecs
import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkprism.llm.common import bounded_sample
from linkprism.runtime import staged

#: (true encoding, wrong encoding, times): text stored as the first was read as the second.
_UTF8_READ_AS = ["cp1252", "latin-1", "cp1250", "iso8859-2", "iso8859-15", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "cp866"]
_LEGACY = {
    "cp1251": ["cp1252", "koi8-r", "mac_roman", "cp866"],
    "koi8-r": ["cp1252", "cp1251"],
    "cp866": ["cp1252", "cp1251"],
    "gbk": ["cp1252"],
    "big5": ["cp1252"],
    "shift_jis": ["cp1252", "mac_roman"],
    "euc_jp": ["cp1252"],
    "cp1250": ["cp1252"],
    "iso8859-2": ["cp1252"],
    "cp1252": ["cp437", "cp850", "mac_roman", "cp1250", "cp1251"],
    "mac_roman": ["cp1252"],
    "cp850": ["cp1252"],
}
CHAINS: list[tuple[str, str, int]] = [
    *(("utf-8", w, 1) for w in _UTF8_READ_AS),
    *(("utf-8", w, 2) for w in _UTF8_READ_AS),
    *((t, w, 1) for t, ws in _LEGACY.items() for w in ws),
]
SAMPLE_BOUND = 20_000
BINS = 1 << 16
_TOKEN = re.compile(r"[^\t\n\v\f\r ]*[^\x00-\x7f][^\t\n\v\f\r ]*")
_WORD = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"(?=.*[A-Za-z\u00c0-\u024f])(?=.*[\u0370-\u052f])", re.S)
_SYMBOL = re.compile(r"[^\x00-\x7f\w]")
_EAST = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]")
_CJK = ("gbk", "big5", "shift_jis", "euc_jp")
#: Signs and spaces of careful typography: alone they are no sign of a one-to-one or East Asian chain.
_TYPOGRAPHY = frozenset("\u00a0\u00ad«»„“”‘’‚‹›…–—™®©°½¼¾¿¡·•\u2007\u2009\u202f\u200b\u200c\u200d\u2060\ufeff\u3000")
_SPACING = _TYPOGRAPHY - frozenset("¿¡½¼¾®©°™·•")
_MULTIBYTE = ("utf-8", "gbk", "big5", "shift_jis", "euc_jp")


def _tables() -> tuple[dict[str, str], dict[str, object]]:
    """Decoding and encoding tables of the single-byte encodings.

    Bytes that a Windows code page leaves undefined stay as control characters, as
    careless readers keep them.
    """
    read: dict[str, str] = {}
    for enc in sorted({w for _, w, _ in CHAINS}):
        chars = []
        for x in range(256):
            try:
                chars.append(bytes([x]).decode(enc))
            except UnicodeDecodeError:
                chars.append(chr(x) if enc.startswith("cp125") else "\ufffe")
        read[enc] = "".join(chars)
    return read, {enc: codecs.charmap_build(t) for enc, t in read.items()}


_READ, _WRITE = _tables()


def _spaced(text: str) -> str:
    return text.replace("\u00c3  ", "\u00c3\u00a0 ")  # the second byte of a garbled à, since turned into a plain space


def _words(text: str) -> list[str]:
    """Words as ``GarbleModel.known`` looks them up; tokens with symbols count as a whole too."""
    return [w for tok in text.split() for w in (_WORD.findall(tok.lower()) + [_core(tok)] * bool(_SYMBOL.search(tok)))]


def _core(token: str) -> str:
    return token.lower().strip(string.punctuation)


def garble(t: str, chain: tuple[str, str, int]) -> str | None:
    """``t`` as a reader with the wrong encoding sees it; null if the chain cannot produce it."""
    true, wrong, times = chain
    for _ in range(times):
        try:
            t = codecs.charmap_decode(t.encode(true), "strict", _READ[wrong])[0]
        except UnicodeError:
            return None
    return t


def restore(t: str, chain: tuple[str, str, int]) -> str | None:
    """Strict inverse of ``garble``."""
    true, wrong, times = chain
    for _ in range(times):
        try:
            t = codecs.charmap_encode(t, "strict", _WRITE[wrong])[0].decode(true)
        except UnicodeError:
            return None
    return t


def _bigrams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(token number, hashed byte bigram) of all tokens, ASCII in lower case, pairs of two ASCII bytes left out."""
    joined = "".join(f" {t} " for t in tokens).encode("utf-8", "surrogatepass")
    sizes = np.fromiter((len(t.encode("utf-8", "surrogatepass")) + 2 for t in tokens), dtype=np.int64, count=len(tokens))
    b = np.frombuffer(joined, dtype=np.uint8).astype(np.int64)
    b = np.where((b >= 65) & (b <= 90), b + 32, b)
    who = np.repeat(np.arange(len(tokens)), sizes)
    keep = ((b[:-1] >= 128) | (b[1:] >= 128)) & (who[:-1] == who[1:])
    return who[:-1][keep], ((b[:-1] << 8) | b[1:])[keep] % BINS


@dataclass
class GarbleModel:
    """Log probabilities, one row per hashed bigram; column 0 is clean, then the chains.

    ``words`` counts words: those of the training sample after ``fit``, those of all
    texts where ``repaired`` decides.
    """

    logp: np.ndarray
    words: dict[str, int]
    chains: list[tuple[str, str, int]] = field(default_factory=lambda: CHAINS)
    token_margin: float = 1.5
    text_margin: float = 4.0
    single_margin: float = 8.0

    def scores(self, tokens: list[str]) -> np.ndarray:
        who, grams = _bigrams(tokens)
        out = np.zeros((len(tokens), self.logp.shape[1]), dtype=np.float64)
        if len(grams):
            starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            out[who[starts]] = np.add.reduceat(self.logp[grams], starts, axis=0)
        return out

    def known(self, token: str) -> float:
        """Mean log count of the token's words; a token with symbols is no better known than as a whole."""
        words = _WORD.findall(token.lower())
        mean = sum(math.log(self.words.get(w, 0) + 0.5) for w in words) / max(1, len(words))
        if words and not _SYMBOL.search(token):
            return mean
        whole = math.log(self.words.get(_core(token), 0) + 0.5)
        return min(mean, whole) if words else whole

    def tries(self, tokens: list[str]) -> list[tuple[int, int, float, str]]:
        """(token number, chain, log odds, restored) where the classifier prefers a chain and its inverse decodes."""
        tried = []
        for i, (tok, row) in enumerate(zip(tokens, self.scores(tokens))):
            for c in np.flatnonzero(row[1:] > row[0] + self.token_margin):
                back = restore(tok, self.chains[c])
                if back is not None and back != tok and not any(x in "\ufffd\u2028\u2029" or ord(x) < 32 or 0x7F <= ord(x) < 0xA0 for x in back):
                    tried.append((i, int(c), float(row[c + 1] - row[0]), back))
        return tried

    def asks(self, tokens: list[str]) -> list[list[str]]:
        """Per token the words whose counts ``gains`` looks up."""
        out: list[dict[str, None]] = [{} for _ in tokens]
        for i, _, _, back in self.tries(tokens):
            out[i].update(dict.fromkeys(w for t in (tokens[i], back) for w in (*_WORD.findall(t.lower()), _core(t))))
        return [list(x) for x in out]

    def gains(self, tokens: list[str]) -> list[list[tuple[int, float, str]]]:
        """Per token the (chain, gain, restored) that explain it better than clean text does.

        The inverse must decode strictly. The gain adds to the classifier's log odds how
        much likelier and better known the restored token is than what stands there. A
        chain that maps letters one to one always decodes, so there the gain is 0 unless
        the restored words are clearly better known and no letter turns into a symbol.
        """
        found: list[list[tuple[int, float, str]]] = [[] for _ in tokens]
        tried = self.tries(tokens)
        if not tried:
            return found
        clean, here = self.clean_mean([b for *_, b in tried]), self.clean_mean(tokens)
        for (i, c, gain, back), mean in zip(tried, clean):
            if self.chains[c][0] != "utf-8" and all(x < "\x80" or x in _TYPOGRAPHY for x in tokens[i]):
                continue
            better = self.known(back) - self.known(tokens[i])
            if self.chains[c][0] in _CJK:  # a few bytes always make a character or two
                east = len(_EAST.findall(back))
                if not east or east < 2 and len(back) > 2 or east < 3 and better < -0.5:
                    continue
            gain += 2 * better + 2 * min(4.0, (mean if not back.isascii() else -6.0) - here[i])
            if self.chains[c][0] not in _MULTIBYTE:
                if len(_SYMBOL.findall(back)) > len(_SYMBOL.findall(tokens[i])) or better < -0.5:
                    continue
                if len(back) == len(tokens[i]) and any(x in _SPACING and x != y for x, y in zip(tokens[i], back)):
                    continue
                # A single letter is a word of many languages: it must be far better known.
                gain = gain if better > (1 if max(map(len, _WORD.findall(back)), default=0) > 1 else 3) else 0.0
            elif gain <= self.token_margin:
                continue
            found[i].append((c, gain, back))
        return found

    def clean_mean(self, tokens: list[str]) -> np.ndarray:
        """Mean clean log probability per bigram."""
        who, grams = _bigrams(tokens)
        total = np.bincount(who, weights=self.logp[grams, 0], minlength=len(tokens))
        return total / np.maximum(1, np.bincount(who, minlength=len(tokens)))

    def decide(self, text: str, cache: dict[str, list] | None = None) -> tuple[str | None, str | None]:
        """(chain name, restored text) of a garbled text, (null, null) of a clean one.

        A text with replacement characters is garbled beyond repair: ('lossy', null).
        """
        cache = {} if cache is None else cache
        text = _spaced(text)
        total: dict[int, float] = {}
        back: dict[int, dict[str, str]] = {}
        tokens = _TOKEN.findall(text)
        if new := [t for t in dict.fromkeys(tokens) if t not in cache]:
            cache.update(zip(new, self.gains(new)))
        for tok in tokens:
            for c, g, b in cache[tok]:
                total[c] = total.get(c, 0.0) + g
                back.setdefault(c, {})[tok] = b
        lossy = "�" in text
        if not total:
            return ("lossy", None) if lossy else (None, None)
        c = max(total, key=lambda k: (total[k], -k))
        enough = self.text_margin if self.chains[c][0] in _MULTIBYTE else self.single_margin
        mixed = sum(1 for t in tokens if t not in back[c] and _MIXED.match(t))  # look-alikes, another problem
        if total[c] < enough or mixed >= sum(t in back[c] for t in tokens):
            return ("lossy", None) if lossy else (None, None)
        fixed = _TOKEN.sub(lambda m: back[c].get(m.group(), m.group()), text)
        true, wrong, times = self.chains[c]
        return f"{true}>{wrong}" + (f"x{times}" if times > 1 else ""), None if lossy else fixed


def fit(texts: list[str], rounds: int = 2, alpha: float = 0.02) -> GarbleModel:
    """Fit on texts that are mostly clean; later rounds leave out what the model so far finds garbled."""
    model, kept = None, texts
    for _ in range(rounds):
        if model is not None:
            cache: dict[str, list] = {}
            kept = [t for t in texts if model.decide(t, cache)[0] is None]
        tokens = Counter(tok for t in kept for tok in _TOKEN.findall(t) if "\ufffd" not in tok)
        words = Counter(w for t in kept for w in _words(t))
        names, weights = list(tokens), np.fromiter(tokens.values(), dtype=np.float64, count=len(tokens))
        counts = np.zeros((BINS, len(CHAINS) + 1))
        for c, chain in enumerate([None, *CHAINS]):
            made = [(g, n) for t, n in zip(names, weights) if (g := t if chain is None else garble(t, chain)) and (chain is None or g != t)]
            if made:
                who, grams = _bigrams([g for g, _ in made])
                counts[:, c] = np.bincount(grams, weights=np.array([n for _, n in made])[who], minlength=BINS)
        # A chain never seen in training stays near uniform.
        p = (counts + alpha) / (counts.sum(axis=0) + alpha * 4096)
        model = GarbleModel(np.log(p).astype(np.float32), dict(words))
    return model


def fit_from(df: DataFrame, column: str, keys: list[str], bound: int = SAMPLE_BOUND) -> GarbleModel:
    """Fit on at most ``bound`` non-ASCII texts of the corpus (the bound of the training sample), each text once."""
    pool = df.where(F.col(column).rlike(r"[^\x00-\x7f]")).select(*keys, F.col(column).alias("_t"))
    return fit(sorted({r[0] for r in bounded_sample(pool, keys, bound).select("_t").collect()}))


def repaired(df: DataFrame, text: str, keys: list[str], bound: int = SAMPLE_BOUND) -> DataFrame:
    """``df`` with ``garble_chain`` and ``restored_text``; both null for clean, ASCII, blank or null text.

    The classifier is fitted on at most ``bound`` rows; the word counts run over all
    non-ASCII rows (among distinct texts a short one and its garbled form would count
    alike) but those that it surely finds garbled, and are joined to the texts that ask
    for them. ``restored_text`` is null if characters were lost ('lossy' or a
    replacement character).
    """
    c = F.col(text)
    distinct = staged(df.where(c.rlike(r"[^\x00-\x7f]")).groupBy(c.alias("__lp_t")).agg(F.count(F.lit(1)).alias("__lp_n")), "texts")
    model = fit_from(df, text, keys, bound)
    shared = df.sparkSession.sparkContext.broadcast(model)  # BINS x chains floats and the sample's words, whatever the corpus

    @F.pandas_udf("struct<counts:boolean,asks:array<string>>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, cache, asks = shared.value, {}, {}
        for s in batches:
            if len(cache) > 200_000 or len(asks) > 200_000:
                cache.clear()
                asks.clear()
            rows = []
            for t in s:
                tokens = list(dict.fromkeys(_TOKEN.findall(_spaced(t))))
                if new := [x for x in tokens if x not in asks]:
                    asks.update(zip(new, m.asks(new)))
                chain, back = m.decide(t, cache)
                # A one-to-one chain takes a text out of the count only where the sample holds the restored words more than twice.
                sure = chain is not None and (chain.split(">")[0] in ("lossy", *_MULTIBYTE) or back is None or all(m.known(w) > math.log(3) for w in {*back.split()} - {*t.split()}))
                rows.append((not sure, list(dict.fromkeys(w for x in tokens for w in asks[x]))))
            yield pd.DataFrame(rows, columns=["counts", "asks"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total: Counter[str] = Counter()
            for t, n in zip(pdf["__lp_t"], pdf["__lp_n"]):
                for w in _words(t):
                    total[w] += int(n)
            yield pd.DataFrame(list(total.items()), columns=["word", "n"])

    @F.pandas_udf("struct<chain:string,restored:string>")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m, cache = replace(shared.value, words={}), {}
        for s, counts in batches:
            if len(cache) > 200_000 or len(m.words) > 200_000:
                cache.clear()
                m.words.clear()
            rows = []
            for t, known in zip(s, counts):
                if known is not None:
                    m.words.update((x["word"], x["n"]) for x in known)
                rows.append(m.decide(t, cache))
            yield pd.DataFrame(rows, columns=["chain", "restored"], dtype=object)

    looked = staged(distinct.withColumn("_l", look("__lp_t")).select("__lp_t", "__lp_n", F.sha2("__lp_t", 256).alias("__lp_id"), "_l.*"), "asked")
    counts = looked.where("counts").select("__lp_t", "__lp_n").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    asked = looked.where(F.size("asks") > 0)
    known = asked.select("__lp_id", F.explode("asks").alias("word")).join(counts, "word").groupBy("__lp_id").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    judged = asked.select("__lp_id", "__lp_t").join(known, "__lp_id", "left").select("__lp_id", judge("__lp_t", "known").alias("__lp_j"))
    judged = staged(judged.where("__lp_j.chain is not null"), "garbled")
    # Texts without a candidate are clean but for lost characters.
    lossy = F.when(c.contains("\ufffd"), F.lit("lossy"))
    rows = df.withColumn("__lp_id", F.when(c.rlike(r"[^\x00-\x7f]"), F.sha2(c, 256))).join(judged, "__lp_id", "left")
    return rows.withColumns({"garble_chain": F.coalesce("__lp_j.chain", lossy), "restored_text": F.col("__lp_j.restored")}).drop("__lp_j", "__lp_id")


def all_texts(links: DataFrame, pages: DataFrame) -> DataFrame:
    """The non-ASCII texts of both tables as (table_name, record_id, link_pos, text)."""
    a = links.select(F.lit("sample_classified_prompt_links").alias("table_name"), F.col("row_id").alias("record_id"), F.lit(0).alias("link_pos"), F.col("primary_prompt_text").alias("text"))
    b = pages.select(F.lit("demo_pages").alias("table_name"), F.col("page_id").alias("record_id"), F.posexplode(F.col("links.text")).alias("p", "text"))
    b = b.select("table_name", "record_id", (F.col("p") + 1).cast("int").alias("link_pos"), "text")
    return a.unionByName(b).where(F.col("text").rlike(r"[^\x00-\x7f]"))


def garbled_records(links: DataFrame, pages: DataFrame, bound: int = SAMPLE_BOUND) -> DataFrame:
    return repaired(all_texts(links, pages), "text", ["table_name", "record_id", "link_pos"], bound).where(F.col("garble_chain").isNotNull())
