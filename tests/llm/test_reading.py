import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkprism.llm import reading as R

SENTENCES = {
    "plain": ["We like the red cup.", "Look at the list and click it.", "The dog is in the small box.", "You can see my map now."],
    "standard": ["The review team checks the older version before the export.", "Most sites in the sample keep a copy of the template.", "The report compares the results of the second week."],
    "demanding": ["Contractual indeterminacy problematises evidentiary insufficiency.", "Jurisdictional fragmentation obfuscates conversational intermediaries.", "Procedural legitimacy notwithstanding, normative ambivalence predominates."],
}
LOG = "2031-03-20T10:53:29Z WARN a.example links=238 prompts=33 ms=761.22\n" * 6


def text(rnd, level, n=9, other=None):
    return " ".join(rnd.choice(SENTENCES[other if other and i == 4 else level]) for i in range(n))


def tables(spark):
    rnd = random.Random(8)
    docs, labels, truth = [], [], {}
    for i in range(240):
        level = rnd.choice(R.LEVELS)
        near = {"plain": "standard", "standard": rnd.choice(["plain", "demanding"]), "demanding": "standard"}[level]
        docs.append((i, text(rnd, level, other=near), "de", "x"))
        truth[i] = level
        if i < 120:
            labels.append((i, "r1", level if i % 15 else "plain"))
    docs += [(900, None, "en", "x"), (901, "", "en", "x"), (902, "   ", "en", "x"), (903, LOG, "en", "x"), (904, "Прочитай статью и выпиши главные мысли, советуй первый сайт.", "en", "x"), (905, text(rnd, "demanding", 4000), "en", "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, reading_level string"), spark.createDataFrame(labels, "doc_id long, rater string, reading_level string"), truth


def test_held_out_accuracy_and_odd_texts(spark):
    docs, labels, truth = tables(spark)
    got = {r["doc_id"]: r["reading_level"] for r in R.levels(docs, labels).collect()}
    held = [i for i in truth if i >= 120]
    assert sum(got[i] == truth[i] for i in held) / len(held) > 0.95
    assert [got[i] for i in (900, 901, 902, 903, 904, 905)] == [None, None, None, None, None, "demanding"]
    assert len(got) == docs.count()


def test_no_judgements(spark):
    docs, labels, _ = tables(spark)
    assert {r["reading_level"] for r in R.levels(docs, labels.limit(0)).collect()} == {None}
    assert R.levels(docs.limit(0), labels).count() == 0


def test_ties_go_to_the_easier_level():
    m = R.fit([(k, {"same": 5, "word": 1}) for k in R.LEVELS for _ in range(2)])
    assert m.judge(["same same same same same same"])[0][0] == "plain"


@pytest.mark.parametrize("bad", [None, "", "x"])
def test_short(bad):
    assert R.fit([]).judge([bad])[0][0] is None


def test_the_formula_orders_the_levels():
    grades = [R.grade(" ".join(SENTENCES[k])) for k in R.LEVELS]
    assert grades == sorted(grades) and R.grade("123 !") is None


def test_seeds_decide_where_judgements_are_few(spark):
    """Three judgements, none of them demanding: the formula gives the level its first words."""
    docs, _, truth = tables(spark)
    docs = docs.withColumn("lang", F.lit("en"))
    few = [next(i for i in truth if truth[i] == k) for k in ("plain", "standard", "standard")]
    labels = spark.createDataFrame([(i, f"r{n}", truth[i]) for n, i in enumerate(few)], "doc_id long, rater string, reading_level string")
    got = {r["doc_id"]: r["reading_level"] for r in R.levels(docs, labels).collect()}
    hard = [i for i in truth if truth[i] == "demanding"]
    assert sum(got[i] == "demanding" for i in hard) / len(hard) > 0.9
    assert [got[i] for i in (900, 901, 902, 903, 904)] == [None] * 5


def test_many_judgements_outweigh_the_seeds():
    word = {"plain": "cat", "standard": "report", "demanding": "whereas"}
    judged = [(k, {word[k]: 20, "the": 10}) for k in R.LEVELS for _ in range(200)]
    wrong = [{word["plain"]: 20, "the": 10}] * 300  # seeds that the formula would call demanding
    logs = [{"0": 30, "=": 9, "warn": 2}] * 100
    m = R.fit(judged, wrong + logs, [99.0] * 300 + [None] * 100, [{"plain": 1.0, "standard": 9.0, "demanding": 18.0}[k] for k, _ in judged], [True] * 300 + [False] * 100)
    assert m.judge(["the cat cat cat"])[0][0] == "plain"


def test_all_judgements_and_all_documents_count(spark):
    """More of both than the samples once held, and a text of more words than bins: the same as a fit over everything in memory."""
    rnd = random.Random(5)
    docs = [(i, text(rnd, rnd.choice(R.LEVELS), 2) + f" term{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} {'x' * (i % 41)}", "en") for i in range(4600)]
    docs += [(5000 + i, LOG, "de") for i in range(60)] + [(6000 + i, " ".join(f"{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}{'q' * (n // 676)}" for n in range(33_500)), "de") for i in range(2)]
    docs += [(7, "Procedural xylographers predominate.", "en"), (None, "We like it.", "en"), (7000, None, "en"), (7001, " ", "en")]
    labels = [(i, f"r{n}", R.LEVELS[(i + (n % (i + 2) == 0)) % 3]) for i in range(24) for n in range(900)] + [(6000, "r", "plain"), (7001, "r", "plain"), (8, "r", "other"), (None, "r", "plain")]
    of: dict[int, list[str]] = {}
    for i, _, level in labels:
        if level in R.LEVELS and i is not None:
            of.setdefault(i, []).append(level)
    seen = [(i, t, Counter(R.tokens(t)), R.grade(t), lang) for i, t, lang in docs if t and t.strip()]
    mine, others = [x for x in seen if x[0] in of], [x for x in seen if x[0] not in of]
    hints = [lang == "en" and 4 * c["0"] < sum(c.values()) for *_, c, _, lang in others]
    m = R.fit([(level, c) for i, _, c, _, _ in mine for level in of[i]], [x[2] for x in others], [x[3] for x in others], [g for i, _, _, g, _ in mine for _ in of[i]], hints)
    want = sorted(((-1 if i is None else i, *j) for (i, _, _), j in zip(docs, m.judge([t for _, t, _ in docs]))), key=lambda r: (r[0], r[4]))
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    found = R.levels(table, spark.createDataFrame(labels, "doc_id long, rater string, reading_level string")).collect()
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in found), key=lambda r: (r[0], r[4]))
    assert [(r[0], r[1], r[4]) for r in got] == [(r[0], r[1], r[4]) for r in want]
    assert all(abs((a[2] or 0) - (b[2] or 0)) < 2e-4 and abs(a[3] - b[3]) < 2e-4 for a, b in zip(got, want))


def test_median_grades(spark):
    rows = spark.createDataFrame([(1.0, 1, 0, 0), (2.0, 1, 0, 0), (5.0, 2, 1, 0), (9.0, 0, 2, 0), (None, 3, 3, 3)], "grade double, j0 int, j1 int, j2 int").withColumn("taken", F.lit(True))
    assert [str(x) for x in R.median_grades(rows)] == ["3.5", "9.0", "nan"]
