"""Label texts with a pluggable model: batches through an iterator UDF, the model loaded once per Python worker."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkprism.operators.rules import LABELS, classified

#: Below a label's threshold but at least this likely counts as uncertain (fixed value).
UNCERTAIN = 0.15
Scorer = Callable[[Sequence[str]], Sequence[dict[str, float]]]
#: Batch size, most tokens of a text and device of a model (fixed values: defaults).
BATCH, MAX_TOKENS, DEVICE = 8, 256, "cpu"
_LOADED: dict[tuple, Scorer] = {}


def loaded(load: Callable[[int, str], Scorer], key: tuple) -> Scorer:
    """The scorer of this process: tasks of one worker share it."""
    if key not in _LOADED:
        _LOADED[key] = load(*key[1:])
    return _LOADED[key]


def thresholds(path: str | None) -> dict[str, float]:
    if path is None:
        return dict.fromkeys(LABELS, 0.5)
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    got = got.get("thresholds", got)
    return {k: float(got.get(k, 0.5)) for k in LABELS}


def model_classified(df: DataFrame, text: str, load: Callable[[int, str], Scorer], limits: dict[str, float], name: str, batch: int = BATCH, max_tokens: int = MAX_TOKENS, device: str = DEVICE) -> DataFrame:
    """``df`` with classification columns from the probabilities of ``load(max_tokens, device)``, the model called ``name``.

    The scorer cuts texts at ``max_tokens`` of its own tokens. Blank and null texts get
    zeros and no label.
    """

    @F.pandas_udf("map<string,double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = loaded(load, (name, max_tokens, device))
        for s in batches:
            out = [dict.fromkeys(LABELS, 0.0) for _ in s]
            at = [i for i, t in enumerate(s) if t and t.strip()]
            for k in range(0, len(at), batch):
                part = at[k : k + batch]
                for i, p in zip(part, scorer([s.iloc[j] for j in part]), strict=True):
                    out[i] = {x: float(p.get(x, 0.0)) for x in LABELS}
            yield pd.Series(out, dtype=object)

    scored = df.withColumn("__lp_p", score(F.col(text)))
    over = F.array_compact(F.array(*[F.when(F.col("__lp_p")[x] >= limits[x], F.lit(x)) for x in LABELS]))
    unsure = F.lit(False)
    for x in LABELS:
        unsure = unsure | ((F.col("__lp_p")[x] < limits[x]) & (F.col("__lp_p")[x] >= UNCERTAIN))
    return classified(scored, over, "model", "model", name, F.col("__lp_p"), unsure).drop("__lp_p")
