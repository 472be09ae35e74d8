import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linkprism.llm import duplicates as D

SCHEMA = "row_id long, crawl string, primary_prompt_text string, target_url string, digest string"


def test_trie():
    rnd = random.Random(2)
    keys = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))).encode() for _ in range(800)]
    t, want = D.Trie(), defaultdict(lambda: [0, 10**9])
    for i, k in enumerate(keys):
        t.add(k, 1, i, k)
        want[k][0] += 1
        want[k][1] = min(want[k][1], i)
    assert {x[2]: x[:2] for x in t.terminals()} == dict(want)


@pytest.mark.parametrize("fit", [1, 300, D.FIT_CHARS])
def test_copies_against_brute_force(spark, fit):
    rnd = random.Random(fit)
    rows = []
    for i in range(700):
        k = 0 if rnd.random() < 0.35 else rnd.randint(1, 90)  # a third of the rows are one record
        text = f"Straße Nummer {k}, bitte!"
        text = rnd.choice([str, str.upper, str.lower])(text).replace(" ", rnd.choice([" ", "  ", "\n", " "])).replace(",", rnd.choice([",", "", ";"]))
        params = ["q=a%20b" if rnd.random() < 0.5 else "Q=A+b!", f"x={k}", "y=%C3%A9" if rnd.random() < 0.5 else "y=é"]
        rnd.shuffle(params)
        rows.append((i, rnd.choice(["c1", "c2"]), text, rnd.choice(["HTTPS", "https"]) + "://h.test/P%61th?" + "&".join(params), "clash", k))
    want = defaultdict(list)
    for i, c, _, _, _, k in rows:
        want[(c, k)].append(i)
    rows = [r[:5] for r in rows] + [(9001, "c1", None, "u", None), (9002, "c1", "  ", "u", None), (9003, None, "t", None, None), (9004, None, "T", None, None), (9005, "c1", "x" * 200_000, "u?%ZZ", None), (9006, "c1", "X" * 200_000, "U?%zz", None)]
    groups, members = D.copies(spark.createDataFrame(rows, SCHEMA).repartition(3), fit=fit)
    expect = {(min(v), x) for v in want.values() for x in v if x != min(v)} | {(9003, 9004), (9005, 9006)}
    got = [tuple(r) for r in members.collect()]
    assert len(got) == len(set(got)) and set(got) == expect
    counts = {r["first_row_id"]: r["n_copies"] for r in groups.collect()}
    assert counts == {min(v): len(v) for v in want.values()} | {9003: 2, 9005: 2}


def test_different_records_stay_apart(spark):
    rows = [(1, "c", "a b", "h?x=1", None), (2, "c", "a c", "h?x=1", None), (3, "c", "a b", "h?x=2", None), (4, "d", "a b", "h?x=1", None), (5, "c", "a b", "h?x=1&y=", None), (6, "c", "ab ™", "h?x=1", None)]
    _, members = D.copies(spark.createDataFrame(rows, SCHEMA))
    assert members.count() == 0


def test_empty(spark):
    groups, members = D.copies(spark.createDataFrame([], SCHEMA))
    assert groups.count() == members.count() == 0


def test_more_than_4096_buckets_split_against_brute_force(spark):
    rnd = random.Random(9)
    stems = ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(6000)]
    rows = [(i, "c", stems[i % 6000] + rnd.choice(["xx", "yy", "zz"]), "h", None) for i in range(24_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    combined = D.canonical_rows(df, "row_id", "primary_prompt_text", "target_url", "crawl").mapInArrow(D._combine, D._COMBINED).cache()
    levels = D.split_prefixes(combined, 20)
    assert sum(n for *_, n in levels) > 4096 and max(n for *_, n in levels) > 4096
    assert D.bucketed(combined, 20).groupBy("bucket").agg(F.countDistinct("canon").alias("n"), F.sum(F.length("canon")).alias("s")).where("n > 1 and s > 20").count() == 0
    groups, members = D.copies(df, fit=20)
    want = defaultdict(list)
    for i, _, t, *_ in rows:
        want[t].append(i)
    assert {r["first_row_id"]: r["n_copies"] for r in groups.collect()} == {min(v): len(v) for v in want.values()}
    assert {tuple(r) for r in members.collect()} == {(min(v), x) for v in want.values() for x in v if x != min(v)}


def test_long_shared_beginnings_are_split_at_any_depth(spark):
    rows = [(i, "c", "a" * 9000 + str(i % 3), "h", None) for i in range(12)]
    combined = D.canonical_rows(spark.createDataFrame(rows, SCHEMA), "row_id", "primary_prompt_text", "target_url", "crawl").mapInArrow(D._combine, D._COMBINED)
    assert D.bucketed(combined, 20_000).select("bucket").distinct().count() == 3


def test_prefixes_beyond_the_broadcast_bound_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_PREFIXES", 0)
    rows = [(i, "c", f"text number {i % 7}", "h", None) for i in range(60)]
    groups, _ = D.copies(spark.createDataFrame(rows, SCHEMA), fit=10)
    assert sorted(r["n_copies"] for r in groups.collect()) == [8, 8, 8, 9, 9, 9, 9]
