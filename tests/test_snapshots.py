import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkprism.operators import snapshots as S
from linkprism.operators.snapshots import SnapshotStore, merged, snapshot_changes

SCHEMA = "crawl string, link_id long, loaded_at long, row_id long, a string, b string, change_kind string"


def brute(rows, runs):
    state = defaultdict(dict)
    for c, k, t, i, a, b, _ in rows:
        if k is not None and c in runs:
            old = state[runs[c]].get(k)
            if old is None or (t, i) > old[0]:
                state[runs[c]][k] = ((t, i), a, b)
    names = {s: c for c, s in runs.items()}
    out = set()
    for s in range(2, max(runs.values()) + 1):
        before, now = state[s - 1], state[s]
        for k in before.keys() | now.keys():
            kind = "added" if k not in before else "removed" if k not in now else "changed" if before[k][1:] != now[k][1:] else None
            if kind:
                out.add((names[s], k, kind))
    return out


def found(spark, rows, runs):
    df = spark.createDataFrame(rows, SCHEMA)
    r = spark.createDataFrame(list(runs.items()), "crawl string, seq int")
    got = snapshot_changes(df, r, "crawl", "link_id", ["loaded_at", "row_id"], ["a", "b"], 3).collect()
    assert len(got) == len({tuple(x) for x in got})
    return {tuple(x) for x in got}


def test_against_brute_force(spark):
    rnd = random.Random(3)
    runs = {"w": 1, "x": 2, "y": 3, "z": 4}
    rows = [(rnd.choice([*runs, "other", None]), rnd.choice([None, *range(60)]), rnd.randint(0, 4), i, rnd.choice(["p", "q", None, ""]), rnd.choice(["p", None]), "extra") for i in range(900)]
    rows += [("y", 7, rnd.randint(0, 9), 10_000 + i, "hot", "hot", None) for i in range(500)]
    assert found(spark, rows, runs) == brute(rows, runs)


def test_null_equals_null_and_first_adds_nothing(spark):
    rows = [("a", 1, 1, 1, None, "u", None), ("b", 1, 1, 2, None, "u", None), ("b", 2, 1, 3, "s", "u", None)]
    assert found(spark, rows, {"a": 1, "b": 2}) == {("b", 2, "added")}


def test_an_empty_snapshot_in_between(spark):
    rows = [("a", 1, 1, 1, "s", "u", None), ("c", 1, 1, 2, "s", "u", None)]
    assert found(spark, rows, {"a": 1, "b": 2, "c": 3}) == {("b", 1, "removed"), ("c", 1, "added")}


def test_empty_tables(spark):
    assert found(spark, [], {"a": 1, "b": 2}) == set()
    df = spark.createDataFrame([("a", 1, 1, 1, "s", "u", None)], SCHEMA)
    none = spark.createDataFrame([], "crawl string, seq int")
    assert snapshot_changes(df, none, "crawl", "link_id", ["loaded_at"], ["a"]).collect() == []


def test_merge_of_blocks_against_sets():
    rnd = random.Random(6)
    for _ in range(200):
        a = {k: rnd.choice("xy") for k in rnd.sample(range(40), rnd.randint(0, 30))}
        b = {k: rnd.choice("xy") for k in rnd.sample(range(40), rnd.randint(0, 30))}

        def runs(d):
            keys = sorted(d)
            while keys:
                n = rnd.randint(1, 9)
                part, keys = keys[:n], keys[n:]
                yield np.array(part), np.array([d[k] for k in part], dtype=object)

        got = {(kind, int(k)) for kind, ks in merged(runs(a), runs(b)) for k in ks}
        assert got == {("added", k) for k in b.keys() - a.keys()} | {("removed", k) for k in a.keys() - b.keys()} | {("changed", k) for k in a.keys() & b.keys() if a[k] != b[k]}


def test_a_store_takes_snapshots_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 7)
    rnd = random.Random(12)
    path = str(tmp_path / "store")
    days = [{f"k{rnd.randint(0, 90)}": rnd.choice([None, "p", "q"]) for _ in range(70)} for _ in range(3)]
    frames = [spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(d.items())] * 2 + [(None, "x", 0)], "k string, v string, o long") for d in days]
    SnapshotStore.create(frames[0].select("k"), path, 4).write(frames[0], F.lit(1), "k", ["o"], ["v"])
    for n, f in enumerate(frames[1:], 2):
        SnapshotStore.open(spark, path).write(f, F.lit(n), "k", ["o"], ["v"])
    store = SnapshotStore.open(spark, path)
    assert len(store.bounds) == 3 and {s for s, _ in store.files()} == {1, 2, 3}
    df = store.changes([(1, 2, "b"), (2, 3, "c")], T.StructField("day", T.StringType()), T.StructField("k", T.StringType()))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    want = set()
    for a, b, n in zip(days, days[1:], "bc"):
        want |= {(n, k, "added") for k in b.keys() - a.keys()} | {(n, k, "removed") for k in a.keys() - b.keys()} | {(n, k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)


def test_mark_tells_apart(spark):
    rows = [("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("ab", None), (None, None), ("-", None)]
    df = spark.createDataFrame(rows, "a string, b string").select(S.state_mark(["a", "b"]).alias("m"))
    assert df.distinct().count() == len(rows)
