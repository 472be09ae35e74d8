import math
import random

from pyspark.sql import functions as F

from linkprism.operators.hotkeys import exact_quantiles, key_report

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]


def brute(values):
    v = sorted(x for x in values if x is not None)
    return [v[max(1, math.ceil(round(p * len(v), 9))) - 1] for p in PROBS] if v else None


def run(spark, rows, bits=3):
    df = spark.createDataFrame(rows, "k string, v long")
    return {r["k"]: r for r in exact_quantiles(df, ["k"], "v", PROBS, bits).collect()}


def test_against_brute_force_with_a_hot_key(spark):
    rnd = random.Random(1)
    rows = [("hot", rnd.choice([7, -5, 100_000, rnd.randint(-900, 900)])) for _ in range(3000)]
    rows += [(f"k{i % 40}", rnd.randint(0, 5)) for i in range(500)] + [(None, 3), (None, 9), ("null", None), ("one", 2**40), ("hot", None)]
    got = run(spark, rows)
    for k in {r[0] for r in rows}:
        own = [v for key, v in rows if key == k]
        assert got[k]["n_rows"] == len(own)
        assert got[k]["quantiles"] == brute(own), k


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_all_values_null(spark):
    got = run(spark, [("a", None), ("a", None)])
    assert got["a"]["n_rows"] == 2 and got["a"]["n_values"] == 0 and got["a"]["quantiles"] is None


def test_report_counts_null_keys_in_the_total(spark):
    rows = [(" Site.Test", "x", 1)] * 2 + [("site.test ", "x", 2), (None, "y", 3), ("  ", None, 4)]
    df = spark.createDataFrame(rows, "a string, b string, key_field int")  # a clashing column
    got = {(r["key_field"], r["key_value"]): r for r in key_report(df, ["a", "b"], F.col("key_field"), [0.5]).collect()}
    assert got[("a", "site.test")]["n_rows"] == 3 and got[("a", "site.test")]["share"] == 0.6
    assert set(got) == {("a", "site.test"), ("b", "x"), ("b", "y")}
