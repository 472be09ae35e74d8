"""Mixing sources to target shares of tokens (problem 9).

Method: soft-membership mixing. A classifier trained on the labelled documents gives
every document a posterior over the sources; a label is strong but not certain
evidence and is weighed with it by Bayes' rule. A distributed projected-gradient
least-squares fit finds nonnegative document rates, capped by the sources' repeats,
whose expected token totals match the targets. Each step is one distributed sum over
the documents' memberships; the rate of a document is replayed from the short history
of residuals, so no state beside the memberships is kept. Rates become whole copies by
exact selection: a document's hash over the fractional part of its rate orders the
documents of a source, and the first ones get one more copy until the source's tokens
are met, the threshold being found by refining histograms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkprism.llm import tokenize
from linkprism.llm.common import bounded_sample
from linkprism.runtime import staged

SAMPLE_BOUND = 10_000
BINS = 1 << 16
STEPS = 40
TOLERANCE = 1e-4
#: Share of the largest possible total that is mixed: with no slack the scarcest source stays at its cap and the fit creeps.
FILL = 0.999
#: Likelihood that a label names another source than the document's.
LABEL_ERROR = 0.0001
#: Selection keys: hashes of so many bits, over the rate's fraction, below so many bits.
HASH_BITS, KEY_BITS = 50, 60
_WORD = re.compile(r"[^\W_]+|\n+|[<>/=:\[\]{}]")


def source_name(c) -> object:
    return F.nullif(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), F.lit(""))


def _features(text: str) -> np.ndarray:
    return np.array([hash_word(w) for w in set(_WORD.findall(text.lower()))], dtype=np.int64)


@lru_cache(maxsize=1 << 18)
def hash_word(w: str) -> int:
    return xxhash.xxh32_intdigest(w) % BINS


@dataclass
class SourceModel:
    logp: np.ndarray
    prior: np.ndarray
    heat: float = 1.0

    def posterior(self, text: str | None) -> np.ndarray:
        s = self.prior.copy()
        if text and len(f := _features(text)):
            s = s + self.logp[f].sum(axis=0) / self.heat
        p = np.exp(s - s.max())
        return p / p.sum()


def fit_sources(rows: list[tuple[str, int]], n: int) -> SourceModel:
    """Multinomial on hashed words; the heat that softens posteriors is chosen on a held-out fifth."""
    m, prior = np.full((BINS, n), 0.1), np.ones(n)
    feats = [(_features(t), k) for t, k in rows]
    for i, (f, k) in enumerate(feats):
        if i % 5:
            m[f, k] += 1
            prior[k] += 1
    logp, prior = np.log(m / m.sum(axis=0)), np.log(prior / prior.sum())
    held = [(logp[f].sum(axis=0), k) for f, k in feats[::5]]
    raw, own = np.array([s for s, _ in held]).reshape(-1, n), np.array([k for _, k in held], dtype=int)
    best, chosen = -np.inf, 1.0
    for heat in (1, 2, 4, 8, 16, 32, 64, 128):
        s = prior + raw / heat
        s = s - s.max(axis=1, keepdims=True) if len(s) else s
        fit = float((s[np.arange(len(own)), own] - np.log(np.exp(s).sum(axis=1))).sum())
        if fit > best:
            best, chosen = fit, float(heat)
    return SourceModel(logp, prior, chosen)


def with_label(p: np.ndarray, k: int | None, error: float = LABEL_ERROR) -> np.ndarray:
    """The posterior after the label ``k``, which is wrong with likelihood ``error``; without a label it stays."""
    if k is None:
        return p
    said = np.full(len(p), error / max(1, len(p) - 1))
    said[k] = 1.0 - error
    p = p * said
    return p / p.sum()


def sized(docs: DataFrame, sources: list[str], vocabulary: str = tokenize.VOCABULARY, bound: int = SAMPLE_BOUND) -> DataFrame:
    """(doc_id, place int, n_tokens, member array<double>) of every document with tokens.

    ``place`` is the number of the labelled source, -1 without a label. The classifier
    is fitted on at most ``bound`` labelled documents. Documents of a source without
    target belong to no mixture and are left out.
    """
    d = docs.select("doc_id", "text", source_name(F.col("source")).alias("_s"))
    train = bounded_sample(d.where(F.col("_s").isin(sources) & F.col("text").isNotNull()), ["doc_id"], bound).select("text", "_s").collect()
    model = fit_sources(sorted((r[0], sources.index(r[1])) for r in train), len(sources))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS x sources

    @F.pandas_udf("array<double>")
    def soft(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, places in batches:
            yield pd.Series([list(with_label(shared.value.posterior(t), k if k >= 0 else None)) for t, k in zip(texts, places)], dtype=object)

    places = F.create_map(*[x for i, s in enumerate(sources) for x in (F.lit(s), F.lit(i))])
    place = F.when(F.col("_s").isNull(), F.lit(-1)).otherwise(F.try_element_at(places, F.col("_s")))
    known = tokenize.counted(d.withColumn("place", place).where("place is not null"), "text", vocabulary)
    return known.select("doc_id", "place", "n_tokens", soft("text", "place").alias("member")).where("n_tokens > 0")


def replay(member: np.ndarray, cap: np.ndarray, history: list[np.ndarray], start: float) -> np.ndarray:
    """Rates after the steps of ``history``: r <- clip(r - member . step, 0, cap)."""
    r = np.minimum(cap, start)
    for step in history:
        r = np.clip(r - member @ step, 0.0, cap)
    return r


def _members(pdf: pd.DataFrame, n: int, caps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Memberships and caps of a batch; a document without label may occur as often as the least repeatable source."""
    place = pdf["place"].to_numpy()
    return np.array(pdf["member"].tolist()).reshape(-1, n), np.where(place >= 0, caps[place], caps.min())


def fit_rates(sized: DataFrame, caps: np.ndarray, target: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], np.ndarray, float]:
    """(history, expected tokens, budget) of the projected-gradient fit, started at one copy of each document.

    The budget is the largest total that the labelled documents alone can fill within
    their repeats, so the fit has a solution whatever the unlabelled ones are. A source
    without labelled documents cannot be filled; the others keep their proportions.
    """
    n = len(target)

    def totals(history: list[np.ndarray], labelled_full: bool = False) -> np.ndarray:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = np.zeros(n)
            for pdf in batches:
                m, cap = _members(pdf, n, caps)
                r = np.where(pdf["place"] >= 0, cap, 0.0) if labelled_full else replay(m, cap, history, 1.0)
                acc += (r * pdf["n_tokens"].to_numpy()) @ m
            yield pd.DataFrame([acc], columns=[f"t{i}" for i in range(n)])

        got = sized.mapInPandas(part, ", ".join(f"t{i} double" for i in range(n))).agg(*[F.sum(f"t{i}") for i in range(n)]).first()
        return np.array([x or 0.0 for x in got])

    labelled = {r["place"] for r in sized.where("place >= 0").select("place").distinct().collect()}  # at most the sources
    have = totals([], labelled_full=True)
    usable = (target > 0) & (have > 0) & np.array([i in labelled for i in range(n)])
    if not usable.any():
        return [], np.zeros(n), 0.0
    goal = np.where(usable, target, 0.0)
    goal = goal / goal.sum()
    budget = FILL * float((have[usable] / goal[usable]).min())
    now = totals([])
    scale = np.where(now > 0, budget / np.maximum(now, 1.0), 0.0)  # inverse curvature of each source's total
    history: list[np.ndarray] = []
    for _ in range(steps):
        residual = now / budget - goal
        if np.abs(residual).max() < tolerance:
            break
        history.append(scale * residual)
        now = totals(history)
    return history, now, budget


def mixture(docs: DataFrame, targets: DataFrame, vocabulary: str = tokenize.VOCABULARY, bound: int = SAMPLE_BOUND) -> DataFrame:
    """(doc_id, source, labelled, n_tokens, member, rate, copies) of the documents that occur in the mixture.

    ``targets`` (source, target_share, max_repeats) has one row per source. Every
    document with tokens takes part by its posterior; those without tokens and those of
    a source that is no target never occur. ``source`` is the label, without one the
    most likely source (``member`` has its posterior), and such a document occurs at most as often as the least
    repeatable source allows. Empty tables give an empty mixture.
    """
    rows = [r for r in targets.collect() if r["source"]]
    sources = [r["source"].strip().lower() for r in rows]
    caps = np.array([float(r["max_repeats"] or 0) for r in rows])
    target = np.array([float(r["target_share"] or 0) for r in rows])
    n = len(sources)
    if not n:
        return docs.select("doc_id", F.lit("").alias("source"), F.lit(False).alias("labelled"), F.lit(0).cast("long").alias("n_tokens"), F.array(F.lit(0.0)).alias("member"), F.lit(0.0).alias("rate"), F.lit(0).alias("copies")).limit(0)
    size = staged(sized(docs, sources, vocabulary, bound), "sized")
    history, _, budget = fit_rates(size, caps, target)

    @F.pandas_udf("struct<rate:double,top:int>")
    def rate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for member, place in batches:
            m, cap = _members(pd.DataFrame({"member": member, "place": place}), n, caps)
            top = np.where(place >= 0, place, m.argmax(axis=1))
            yield pd.DataFrame({"rate": replay(m, cap, history, 1.0).round(9) if budget else np.zeros(len(m)), "top": top.astype("int32")})

    names = F.array(*[F.lit(s) for s in sources])
    order = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - HASH_BITS)
    placed = size.select("doc_id", "place", "n_tokens", "member", rate("member", "place").alias("r"), order.alias("_o"))
    fraction = F.col("r.rate") - F.floor("r.rate")
    key = F.least(F.col("_o") / fraction, F.lit(float((1 << KEY_BITS) - 1))).cast("long")
    placed = placed.select("doc_id", "place", "n_tokens", "member", F.col("r.rate").alias("rate"), F.col("r.top").alias("top"), F.when(fraction > 0, key).alias("key"))
    placed = staged(placed, "placed")
    limits = F.create_map(*[F.lit(x) for kv in _thresholds(placed, n).items() for x in kv])
    extra = F.coalesce(F.col("key") < F.try_element_at(limits, F.col("place")), F.lit(False))
    copies = (F.floor("rate") + extra.cast("int")).cast("int")
    return placed.withColumn("copies", copies).where("copies > 0").select("doc_id", names[F.col("top")].alias("source"), (F.col("place") >= 0).alias("labelled"), "n_tokens", "member", "rate", "copies")


def _thresholds(placed: DataFrame, n: int, bits: int = 12) -> dict[int, int]:
    """Per place (labelled source, or -1) the key below which documents get one more copy.

    Their tokens are the sum of the rates' fractions times the tokens, to within one
    document. Each round reads at most 2**bits sums a place, inside the open prefix.
    """
    some = placed.where("key is not null")
    want = {r["place"]: float(r["w"] or 0) for r in some.groupBy("place").agg(F.sum((F.col("rate") - F.floor("rate")) * F.col("n_tokens")).alias("w")).collect()}
    prefix = dict.fromkeys(want, 0)
    shift = KEY_BITS
    while shift > 0 and want:
        shift -= bits
        open_ = F.create_map(*[F.lit(x) for kv in prefix.items() for x in kv])
        inside = some.where(F.shiftrightunsigned("key", shift + bits) == open_[F.col("place")]) if shift + bits < KEY_BITS else some
        sums = inside.groupBy("place", F.shiftrightunsigned("key", shift).alias("b")).agg(F.sum("n_tokens").alias("t")).collect()  # at most places x 2**bits
        by: dict[int, dict[int, int]] = {}
        for r in sums:
            by.setdefault(r["place"], {})[r["b"]] = r["t"]
        for s in want:
            at = prefix[s] << bits
            last = at + (1 << bits) - 1
            for b in sorted(by.get(s, {})):
                if by[s][b] > want[s]:
                    last = b
                    break
                want[s] -= by[s][b]
            prefix[s] = last
    return prefix or {-1: 0}


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, n_docs, n_copies, most_copies, n_tokens, actual_share); a source that is missing has zeros.

    Labelled documents count wholly for their label; tokens of the others count by
    their posterior, so ``n_tokens`` is an expectation, rounded. ``n_docs``,
    ``n_copies`` and ``most_copies`` are of the labelled documents.
    """
    names = [r["source"].strip().lower() for r in targets.select("source").collect() if r["source"]]
    t = F.col("copies") * F.col("n_tokens")
    own = F.col("labelled")
    parts = F.array(*[F.struct(F.lit(x).alias("_s"), F.when(own, (F.col("source") == x).cast("double")).otherwise(F.get("member", F.lit(i))).alias("w")) for i, x in enumerate(names)])
    each = mixed.select("copies", own, t.alias("t"), F.explode(parts).alias("p")).select("copies", "labelled", "t", "p.*").where("w > 0")
    got = each.groupBy("_s").agg(F.count_if(F.col("labelled")).alias("n_docs"), F.sum(F.when(F.col("labelled"), F.col("copies"))).alias("n_copies"), F.max(F.when(F.col("labelled"), F.col("copies"))).alias("most_copies"), F.sum(F.col("w") * F.col("t")).alias("n_tokens"))
    total = got.agg(F.sum("n_tokens").alias("_all"))
    joined = targets.select(F.lower(F.trim("source")).alias("source"), "target_share").join(got, F.col("source") == F.col("_s"), "left").crossJoin(total)  # one row
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_copies", "most_copies")]
    return joined.select("source", "target_share", *zero, F.coalesce(F.round("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"), F.coalesce(F.col("n_tokens") / F.col("_all"), F.lit(0.0)).alias("actual_share"))
