"""Reading level of documents (problem 10).

Method: smoothed unigram language models per level, trained on judged documents and on
formula-seeded ones; a document gets the level with the highest posterior. Seeds are
unjudged English texts that a readability formula places; they weigh as much as a
fixed number of words, so they decide where judgements are few and vanish where they
are many. Judgements may err; every judgement counts once. Only English prose has a
level: a unigram mixture of the levels and of a rest, fitted by expectation maximisation
to all documents, tells it, so logs and other languages fall out by their words, digits
and signs.

All judgements and all documents take part. Each text is read once and its token counts
are staged; a round of the mixture is one distributed sum into bins of fixed number, and
the level models are a table by word that is joined, so nothing that grows reaches the driver.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkprism.llm.common import is_text
from linkprism.runtime import staged

LEVELS = ["plain", "standard", "demanding"]
ALPHA = 0.5
#: Words that the seeds of a level weigh.
SEED_WORDS = 1_000.0
#: Grades of the formula between the levels where the judgements do not tell (fixed values: school, college).
GRADES = (7.0, 14.0)
BINS = 1 << 15
ROUNDS, BACKGROUND = 8, 0.1
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|[^\w\s]")
_DIGITS = re.compile(r"\d+")
_HOST = re.compile(r"(?<![\w-])(?:https?://)?(?:[\w-]++\.)+[a-z]{2,}\S*|<[^>]*>", re.I)
_HOST_SIGN = re.compile(r"\.[a-z]{2}|<", re.I)  # every match of _HOST holds one
_VOWELS = re.compile(r"[aeiouy]+")
_STOP = re.compile(r"[.!?]+(?=\s|$)")
#: Tokens this process has met, and their bin, the bin of their shape and their vowel groups; emptied when many.
_PLACES: dict[str, int] = {}
_FACTS = (array("q"), array("q"), array("q"))


def tokens(text: str) -> list[str]:
    """Lower-case words, digits as 0 and single signs; hosts and mark-up are left out."""
    if _HOST_SIGN.search(text):
        text = _HOST.sub(" ", text)
    return _TOKEN.findall(_DIGITS.sub("0", text.lower()))


def is_word(token: str) -> bool:
    return token[0].isalpha()


def features(token: str) -> tuple[int, int]:
    """Bins of a token and of its shape: what stands for words that no sample holds."""
    shape = "w" if token.isascii() and token[0].isalpha() else "x" if token[0].isalpha() else "s"
    return xxhash.xxh32_intdigest(token) % (BINS - 8), BINS - 8 + "wxs".index(shape)


def _place(token: str) -> int:
    k = _PLACES[token] = len(_PLACES)
    for column, x in zip(_FACTS, (*features(token), max(1, len(_VOWELS.findall(token))))):
        column.append(x)
    return k


@dataclass
class Counted:
    """Token counts of some texts: words by ``word_who``, bins by ``bin_who`` (places in the list of texts)."""

    word_who: np.ndarray
    words: list[str]
    uses: np.ndarray
    bin_who: np.ndarray
    bins: np.ndarray
    counts: np.ndarray
    n_words: np.ndarray
    grade: np.ndarray
    few_digits: np.ndarray


def count(texts: list[str | None]) -> Counted:
    """Words, bins, the formula's grade (Flesch-Kincaid by vowel groups; NaN without words) and whether numbers are few."""
    if len(_PLACES) > 500_000:
        _PLACES.clear()
        for column in _FACTS:
            del column[:]
    each = [Counter(tokens(t)) if t else Counter() for t in texts]
    n, place = len(texts), _PLACES
    flat = [t for c in each for t in c]
    who = np.repeat(np.arange(n), np.fromiter(map(len, each), np.int64, n))
    uses = np.fromiter((u for c in each for u in c.values()), np.int64, len(flat))
    at = np.fromiter((place[t] if t in place else _place(t) for t in flat), np.int64, len(flat))
    token, shape, vowels = (np.array(column, dtype=np.int64)[at] for column in _FACTS)
    word = shape < BINS - 6
    total, words, zeros, groups = (np.bincount(who, weights=uses * w, minlength=n) for w in (1, word, at == place.get("0", -1), word * vowels))
    sentences = np.fromiter((max(1, len(_STOP.findall(t))) if t else 1 for t in texts), np.float64, n)
    some = np.maximum(words, 1)
    grades = np.where(words > 0, 0.39 * words / sentences + 11.8 * groups / some - 15.59, np.nan)
    keys, entry = np.unique(np.concatenate([who * BINS + token, who * BINS + shape]), return_inverse=True)
    counts = np.bincount(entry, weights=np.concatenate([uses, uses]), minlength=len(keys)).astype(np.int64)
    return Counted(who[word], [t for t, w in zip(flat, word.tolist()) if w], uses[word], keys // BINS, keys % BINS, counts, words.astype(np.int64), grades, 4 * zeros < total)


def grade(text: str) -> float | None:
    """Flesch-Kincaid grade by vowel groups; null without words."""
    g = count([text]).grade[0]
    return None if np.isnan(g) else float(g)


def bin_sums(who: np.ndarray, bins: np.ndarray, n: np.ndarray, r: np.ndarray) -> np.ndarray:
    """BINS x classes: the weights ``n`` of the documents' bins, shared out by ``r``."""
    return np.array([np.bincount(bins, weights=n * r[who, j], minlength=BINS) for j in range(r.shape[1])]).T


def estimate(sums: np.ndarray, mass: np.ndarray, everything: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(log probabilities per bin, log priors) of the mixture from the sums of a round."""
    share = max(BACKGROUND, 0.5 * 0.75**step)  # words that a class lacks are as likely as this share of what they are anywhere
    logp = np.log((1 - share) * sums / np.maximum(sums.sum(axis=0), 1.0) + share * everything[:, None])
    return logp, np.log((mass + 1) / (mass.sum() + len(mass))) if step else np.zeros(len(mass))


def background(sums: np.ndarray) -> np.ndarray:
    """How likely a bin is anywhere."""
    everything = sums + ALPHA / 8
    return everything / everything.sum()


def posteriors(who: np.ndarray, bins: np.ndarray, n: np.ndarray, total: int, logp: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Documents x classes."""
    s = np.array([np.bincount(who, weights=n * logp[bins, j], minlength=total) for j in range(len(prior))]).T + prior
    p = np.exp(s - s.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit_prose(docs: list[tuple[dict[int, int], str | None]], guesses: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log probabilities per bin, log priors, probability of prose per document); columns are the levels, then the rest.

    ``docs`` are feature counts and the judged level, null where nobody judged; judged
    documents keep their level. ``guesses`` are levels that other documents may have:
    they start there at 0.8, against a rest that is everything; afterwards only the
    words decide.
    """
    k = len(LEVELS)
    who = np.repeat(np.arange(len(docs)), [len(f) for f, _ in docs])
    bins = np.array([b for f, _ in docs for b in f], dtype=np.int64)
    n = np.log1p(np.array([c for f, _ in docs for c in f.values()], dtype=np.float64))  # repeats inside a text say less than other words do
    fixed, r = np.array([level is not None for _, level in docs], dtype=bool), np.zeros((len(docs), k + 1))
    for i, ((_, level), guess) in enumerate(zip(docs, guesses)):
        if level or guess:
            r[i, LEVELS.index(level or guess)] = 1.0 if level else 0.8
    r[:, k] = 1.0
    for step in range(ROUNDS):
        sums = bin_sums(who, bins, n, r)
        if not step:
            everything = background(sums[:, k])
        logp, prior = estimate(sums, r.sum(axis=0), everything, step)
        if not step:
            r[fixed, k] = 0.0
        r[~fixed] = posteriors(who, bins, n, len(docs), logp, prior)[~fixed]
    return logp, prior, 1 - np.where(fixed, 0.0, r[:, k])


@dataclass
class LevelModel:
    """A model in memory, for texts in memory."""

    index: dict[str, int]
    logp: np.ndarray
    prose: np.ndarray
    prior: np.ndarray

    def judge(self, texts: list[str | None]) -> list[tuple[str | None, float | None, float, int]]:
        """(level, posterior, probability of English prose, words) per text; no level for what is not English prose."""
        c, total = count(texts), len(texts)
        rest = posteriors(c.bin_who, c.bins, np.log1p(c.counts), total, self.prose, self.prior)[:, -1]
        prose = np.where(np.bincount(c.bin_who, minlength=total) > 0, 1 - rest, 0.0)
        word = np.array([self.index.get(w, -1) for w in c.words], dtype=np.int64)
        known = word >= 0
        own = np.array([np.bincount(c.word_who[known], weights=c.uses[known] * self.logp[word[known], k], minlength=total) for k in range(len(LEVELS))]).T
        some = np.bincount(c.word_who[known], minlength=total) > 0
        p = np.exp(own - own.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        top = own.argmax(axis=1)
        return [
            (LEVELS[top[i]], round(float(p[i, top[i]]), 4), round(float(prose[i]), 4), int(c.n_words[i])) if some[i] and prose[i] > 0.5 else (None, None, round(float(prose[i]), 4), int(c.n_words[i]))
            for i in range(total)
        ]


def cuts_between(medians: list[float]) -> list[float]:
    """The formula's cuts: halfway between the median grades of neighbouring levels, or at GRADES where a level has no judgement (NaN)."""
    return [(a + b) / 2 if a < b else d for a, b, d in zip(medians, medians[1:], GRADES)]


def fit(judged: list[tuple[str, dict[str, int]]], others: list[dict[str, int]] = (), grades: list[float | None] = (), own: list[float | None] = (), hints: list[bool] = ()) -> LevelModel:
    """The model of ``levels`` for counts in memory: (level, token counts) of judgements, and token counts of other documents.

    ``grades`` and ``own`` are the formula's for these and those, ``hints`` see ``fit_prose``.

    Words of a single document are left out.
    """

    def bins(counts: dict[str, int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for t, c in counts.items():
            for b in features(t):
                out[b] = out.get(b, 0) + c
        return out

    mid = [np.median([g for (lv, _), g in zip(judged, own) if lv == level and g is not None] or [np.nan]) for level in LEVELS]
    cuts = cuts_between(mid)
    guesses = [None if g is None else LEVELS[sum(g > x for x in cuts)] for g in grades]
    start = [g if h else None for g, h in zip(guesses, hints)]
    if judged:
        logp, prior, r = fit_prose([*((bins(c), level) for level, c in judged), *((bins(c), None) for c in others)], [*(None for _ in judged), *start])
    else:
        logp, prior, r = np.zeros((BINS, len(LEVELS) + 1)), np.array([*(-50.0 for _ in LEVELS), 0.0]), np.zeros(len(others))
    seeds = [(g, c) for c, g, p in zip(others, guesses, r[len(judged) :]) if g is not None and p > 0.5]
    docs: dict[str, int] = {}
    for _, counts in (*judged, *seeds):
        for w in counts:
            if is_word(w):
                docs[w] = docs.get(w, 0) + 1
    kept = sorted(w for w, n in docs.items() if n > 1)
    index = {w: i for i, w in enumerate(kept)}

    def table(rows: list[tuple[str, dict[str, int]]]) -> np.ndarray:
        m = np.zeros((len(kept), len(LEVELS)))
        for level, counts in rows:
            for w, c in counts.items():
                if w in index:
                    m[index[w], LEVELS.index(level)] += c
        return m

    m, prior_words = table(judged), table(seeds)
    prior_words = prior_words * (SEED_WORDS / np.maximum(SEED_WORDS, prior_words.sum(axis=0)))
    m = m + prior_words
    return LevelModel(index, np.log((m + ALPHA) / (m.sum(axis=0) + ALPHA * max(1, len(kept)))), logp, prior)


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Token counts of every document, staged: one row each, with the number of its judgements per level (j0, j1, ...).

    ``taken`` documents have a text that is not blank; those with a ``hint`` (a language
    label and few digits) are where the prose model starts for documents without judgement.
    """
    judged = labels.where(F.col("reading_level").isin(LEVELS) & F.col("doc_id").isNotNull())
    judged = judged.groupBy(F.col("doc_id").alias("_d")).agg(*[F.count_if(F.col("reading_level") == level).cast("int").alias(f"j{i}") for i, level in enumerate(LEVELS)])
    english = F.coalesce(F.lower(F.trim(docs["lang"])).startswith("en"), F.lit(False)) if "lang" in docs.columns else F.lit(True)
    texts = docs.select("doc_id", "text", english.alias("hint"), is_text(F.col("text")).alias("taken")).join(judged, F.col("doc_id") == F.col("_d"), "left")
    own = [F.coalesce(f"j{i}", F.lit(0)).alias(f"j{i}") for i in range(len(LEVELS))]
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", *own, "taken", "hint", "text")

    def lists(who: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=n))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, n = count(b["text"].to_pylist()), b.num_rows
            if not n:
                continue
            out = {x: b[x] for x in kept}
            out["hint"] = pc.and_(b["hint"], pa.array(c.few_digits))
            out |= {"grade": pa.array(c.grade, from_pandas=True), "n_words": pa.array(c.n_words, pa.int32())}
            out |= {"words": lists(c.word_who, pa.array(c.words, pa.string()), n), "uses": lists(c.word_who, pa.array(c.uses, pa.int32()), n)}
            out |= {"bins": lists(c.bin_who, pa.array(c.bins, pa.int32()), n), "counts": lists(c.bin_who, pa.array(c.counts, pa.int32()), n)}
            yield pa.RecordBatch.from_pydict(out)

    kept = [x for x in rows.columns if x != "text"]
    schema = ", ".join(f"{x} {rows.schema[x].dataType.simpleString()}" for x in kept)
    return staged(rows.mapInArrow(read, f"{schema}, grade double, n_words int, words array<string>, uses array<int>, bins array<int>, counts array<int>"), "counted")


def median_grades(rows: DataFrame) -> list[float]:
    """Exact median grade of the judgements of each level, NaN without any."""
    of = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"j{i}").alias("n")) for i in range(len(LEVELS))])).alias("j")
    counts = rows.where("taken and grade is not null").select("grade", of).where("j.n > 0").groupBy(F.col("j.level").alias("level"), "grade").agg(F.sum("j.n").alias("n"))
    upto, whole = Window.partitionBy("level").orderBy("grade"), Window.partitionBy("level")
    ranked = counts.select("level", "grade", "n", F.sum("n").over(upto).alias("cum"), F.sum("n").over(whole).alias("total"))
    twice = 2 * F.col("cum")
    middle = ranked.where((twice >= F.col("total")) & (twice - 2 * F.col("n") <= F.col("total")))  # the middle value, or the two around the middle
    found = {r["level"]: r["m"] for r in middle.groupBy("level").agg(F.avg("grade").alias("m")).collect()}
    return [found.get(i, float("nan")) for i in range(len(LEVELS))]


def _entries(bins: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bin, weight) of every entry of a batch; repeats inside a text say less than other words do."""
    who = np.repeat(np.arange(len(bins)), pc.list_value_length(bins).to_numpy(zero_copy_only=False))
    return who, bins.flatten().to_numpy(), np.log1p(counts.flatten().to_numpy().astype(np.float64))


def fit_prose_of(rows: DataFrame, guess: Column) -> tuple[np.ndarray, np.ndarray]:
    """``fit_prose`` over all staged rows: the expectation of a round and the sums of the next are one pass."""
    k = len(LEVELS)
    start = F.when(F.col("hint"), guess).otherwise(F.lit(None)).alias("start")
    own = [f"j{i}" for i in range(k)]
    data, context = rows.where("taken").select(*own, F.coalesce(start, F.lit(-1)).alias("start"), "bins", "counts"), rows.sparkSession.sparkContext
    model = everything = None
    for step in range(ROUNDS):
        shared = context.broadcast(model)  # BINS x classes

        def part(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((BINS + 1, k + 1))  # the last row is the mass of the classes
            for b in batches:
                who, bins, n = _entries(b["bins"], b["counts"])
                r = np.zeros((b.num_rows, k + 1))
                r[:, :k] = np.array([b[x].to_numpy(zero_copy_only=False) for x in own]).T
                fixed = r.any(axis=1)
                if shared.value is None:
                    at = b["start"].to_numpy(zero_copy_only=False)
                    r[:, k] = np.where(fixed, r.sum(axis=1), 1.0)
                    begun = np.flatnonzero(~fixed & (at >= 0))
                    r[begun, at[begun]] = 0.8
                else:
                    r[~fixed] = posteriors(who, bins, n, b.num_rows, *shared.value)[~fixed]
                acc[:BINS] += bin_sums(who, bins, n, r)
                acc[BINS] += r.sum(axis=0)
            used = np.flatnonzero(acc.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(acc[used, j]) for j in range(k + 1))], ["bin", *(f"s{j}" for j in range(k + 1))])

        sums = data.mapInArrow(part, "bin int, " + ", ".join(f"s{j} double" for j in range(k + 1)))
        got = sums.groupBy("bin").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k + 1)]).toArrow()  # at most BINS + 1 rows
        total = np.zeros((BINS + 1, k + 1))
        total[got["bin"].to_numpy()] = np.array([got[f"s{j}"].to_numpy() for j in range(k + 1)]).T
        if not step:
            everything = background(total[:BINS, k])
        model = estimate(total[:BINS], total[BINS], everything, step)
    return model


def level_words(rows: DataFrame, guess: Column) -> DataFrame:
    """(word, l0, l1, ...): log probability of each word per level, of all words that two judgements or seeds hold.

    ``rows`` have ``prose``; seeds are the documents without judgement in English prose.
    """
    k = range(len(LEVELS))
    judged = sum(F.col(f"j{i}") for i in k)
    seed = F.when((judged == 0) & F.col("taken") & (F.col("prose") > 0.5), guess)
    each = rows.withColumn("seed", seed).where((judged > 0) & F.col("taken") | F.col("seed").isNotNull())
    each = each.select(*[f"j{i}" for i in k], "seed", F.when(F.col("seed").isNull(), judged).otherwise(F.lit(1)).alias("n"), F.explode(F.arrays_zip("words", "uses")).alias("w"))
    mine = [F.sum(F.col("w.uses").cast("long") * F.col(f"j{i}")).alias(f"a{i}") for i in k]
    seeds = [F.sum(F.when(F.col("seed") == i, F.col("w.uses").cast("long")).otherwise(0)).alias(f"b{i}") for i in k]
    words = staged(each.groupBy(F.col("w.words").alias("word")).agg(F.sum("n").alias("n"), *mine, *seeds).where("n > 1"), "words")
    whole = words.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"{x}{i}").alias(f"{x}{i}") for x in "ab" for i in k]).first()
    out = []
    for i in k:
        scale = SEED_WORDS / max(SEED_WORDS, whole[f"b{i}"] or 0)
        total = (whole[f"a{i}"] or 0) + (whole[f"b{i}"] or 0) * scale + ALPHA * max(1, whole["n"])
        out.append(F.log((F.col(f"a{i}") + F.col(f"b{i}") * F.lit(scale) + F.lit(ALPHA)) / F.lit(total)).alias(f"l{i}"))
    return words.select("word", *out)


def levels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, reading_level, posterior, prose, n_words) of every document.

    ``prose`` is the probability that the text is English prose. Null, empty and blank
    texts, logs and texts in other languages have a null level; without judgements,
    which show what prose is, all levels are null.
    """
    rows, k = counted(docs, labels), range(len(LEVELS))
    if rows.where(F.col("taken") & (sum(F.col(f"j{i}") for i in k) > 0)).isEmpty():
        return rows.select("doc_id", F.lit(None).cast("string").alias("reading_level"), F.lit(None).cast("double").alias("posterior"), F.lit(0.0).alias("prose"), "n_words")
    guess = sum((F.col("grade") > F.lit(float(c))).cast("int") for c in cuts_between(median_grades(rows)))  # null without a grade
    shared = docs.sparkSession.sparkContext.broadcast(fit_prose_of(rows, guess))  # BINS x classes

    @F.arrow_udf("double")
    def prose(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bins, counts in batches:
            who, b, n = _entries(bins, counts)
            rest = posteriors(who, b, n, len(bins), *shared.value)[:, -1]
            yield pa.array(np.where(np.bincount(who, minlength=len(bins)) > 0, 1 - rest, 0.0))

    told = rows.withColumn("prose", prose.asNondeterministic()("bins", "counts"))  # so that the planner does not copy it into filters
    words = level_words(told, guess)
    each = told.select("row", "doc_id", "prose", "n_words", F.explode_outer(F.when(F.col("prose") > 0.5, F.arrays_zip("words", "uses"))).alias("w"))
    each = each.select("row", "doc_id", "prose", "n_words", F.col("w.words").alias("word"), F.col("w.uses").alias("uses")).join(words, "word", "left")
    own = each.groupBy("row", "doc_id", "prose", "n_words").agg(*[F.sum(F.col("uses") * F.col(f"l{i}")).alias(f"l{i}") for i in k])
    best = F.greatest(*[F.col(f"l{i}") for i in k])
    level = F.coalesce(*[F.when(F.col(f"l{i}") == best, F.lit(name)) for i, name in enumerate(LEVELS)])  # of equal ones the easier; null without known words
    posterior = F.round(1 / sum(F.exp(F.col(f"l{i}") - best) for i in k), 4)
    return own.select("doc_id", level.alias("reading_level"), posterior.alias("posterior"), F.round("prose", 4).alias("prose"), "n_words")
