import os
import random

import numpy as np
import pytest

from linkprism.llm import mixing as X
from linkprism.llm import tokenize

pytestmark = pytest.mark.skipif(not os.path.exists(tokenize.VOCABULARY), reason="no vocabulary")
TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 4)]
WORDS = {"a": "alpha apple arrow answer", "b": "beta bread button bottle", "c": "gamma green garden guitar"}


def documents(n=600):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        s = rnd.choices("abc", [0.7, 0.2, 0.1])[0]
        text = " ".join(rnd.choice(WORDS[s].split()) for _ in range(rnd.randint(20, 60)))
        label = None if i % 50 == 7 else rnd.choice([s, s.upper(), f" {s} "])
        rows.append((i, text, label, s, 0))
    rows += [(n, None, "a", "a", 0), (n + 1, "", "b", "b", 0), (n + 2, "other text", "zzz", "z", 0), (n + 3, " ", None, "z", 0)]
    return rows


@pytest.fixture(scope="module")
def mixed(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string, source string, truth string, copies int")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    m = X.mixture(df, targets).cache()
    return m.collect(), X.shares(m, targets).collect()


def test_shares_and_repeats(mixed):
    rows, shares = mixed
    truth = {r[0]: r[3] for r in documents()}
    cap = {s: c for s, _, c in TARGETS}
    assert len({r["doc_id"] for r in rows}) == len(rows)
    assert all(0 < r["copies"] <= (cap[r["source"]] if r["labelled"] else 1) for r in rows)
    assert all(r["source"] == truth[r["doc_id"]] for r in rows if r["doc_id"] < 600)
    assert {r[0] for r in documents() if r[2] is None} <= {r["doc_id"] for r in rows} | {r[0] for r in documents() if r[2] is None and r[0] % 2}  # no rule drops an unlabelled one
    for r in shares:
        assert abs(r["actual_share"] - r["target_share"]) < 0.015, r
    assert any(not r["labelled"] for r in rows) and {r["most_copies"] for r in shares} != {1}


def test_missing_source_and_empty_tables(spark):
    df = spark.createDataFrame(documents(40), "doc_id long, text string, source string, truth string, copies int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("nowhere", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in X.shares(X.mixture(df, targets), targets).collect()}
    assert got["nowhere"]["n_tokens"] == 0 and got["a"]["actual_share"] > 0.999
    assert X.mixture(df.limit(0), targets).count() == 0


def test_replay_clips():
    r = X.replay(np.array([[1.0, 0.0], [0.5, 0.5]]), np.array([2.0, 1.0]), [np.array([-5.0, 0.0]), np.array([0.5, 0.5])], 1.0)
    assert r.tolist() == [1.5, 0.5]


def test_every_document_with_tokens_takes_part(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string, source string, truth string, copies int")
    got = {r["doc_id"]: r for r in X.sized(df, ["a", "b", "c"]).collect()}
    assert set(got) == {r[0] for r in documents() if r[1] and r[3] != "z"} | {603}
    assert all(abs(sum(r["member"]) - 1) < 1e-9 and min(r["member"]) > 0 for r in got.values())
    assert all(r["member"][r["place"]] > 0.99 for r in got.values() if r["place"] >= 0)


def test_shares_with_a_third_of_the_labels_held_out(spark):
    """Sources whose words overlap: memberships are soft, and the reached shares are counted by the held-out labels."""
    rnd = random.Random(11)
    common = "the page shows links and notes for readers".split()
    rows = []
    for i in range(3000):
        s = rnd.choices("abc", [0.5, 0.3, 0.2])[0]
        text = " ".join(rnd.choice(WORDS[s].split()) if rnd.random() < 0.06 else rnd.choice(common) for _ in range(rnd.randint(15, 40)))
        rows.append((i, text, None if rnd.random() < 0.33 else s, s))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, truth string")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.3, 2), ("c", 0.4, 3)], "source string, target_share double, max_repeats int")
    size = X.sized(df, ["a", "b", "c"]).cache()
    open_ = size.where("place < 0").collect()
    assert 700 < len(open_) and sum(max(r["member"]) < 0.95 for r in open_) > 100  # the soft part has work
    caps, goal = np.array([2.0, 2.0, 3.0]), np.array([0.3, 0.3, 0.4])
    history, now, budget = X.fit_rates(size, caps, goal)
    assert len(history) > 1 and np.abs(now / budget - goal).max() < 1e-3
    truth, real = {r[0]: r[3] for r in rows}, dict.fromkeys("abc", 0)
    mixed = X.mixture(df, targets).collect()
    for r in mixed:
        real[truth[r["doc_id"]]] += r["copies"] * r["n_tokens"]
    total = sum(real.values())
    assert all(abs(real[s] / total - t) < 0.03 for s, t in zip("abc", goal))
    assert all(r["copies"] <= (dict(a=2, b=2, c=3)[r["source"]] if r["labelled"] else 2) for r in mixed)


def test_label_and_posterior_by_bayes():
    p = np.array([0.2, 0.7, 0.1])
    assert X.with_label(p, None) is p
    q = X.with_label(p, 0, 0.1)
    assert abs(q[0] - 0.2 * 0.9 / (0.2 * 0.9 + 0.8 * 0.05)) < 1e-12
