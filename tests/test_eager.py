import random
from collections import defaultdict

from pyspark.sql import functions as F

from tests.conftest import rows
from yieldloom.operators import eager

L = "k string, g string, v double, n int, s_v double"
R = "k string, h string, w double, n string"


def brute(left, right):
    out = defaultdict(lambda: [0, 0.0, 0, 0.0])
    for k, g, v, *_ in left:
        for k2, _, w, *_ in right:
            if k is not None and k == k2:
                o = out[g]
                o[0] += 1
                if v is not None and v == v:
                    o[1] += v
                    o[2] += 1
                if w is not None and w == w:
                    o[3] += w
    return {g: tuple(round(x, 6) for x in o) for g, o in out.items()}


def run(spark, left, right):
    t = eager.eager_join_aggregate(
        spark.createDataFrame(left, L), spark.createDataFrame(right, R), {"k": (F.col("k"), F.col("k"))},
        by_left={"g": F.col("g")}, left_measures={"v": F.col("v")}, right_measures={"w": F.col("w")},
    )
    return {r.g: (r.n, round(r.s_v, 6), r.c_v, round(r.s_w, 6)) for r in t.collect()}


def test_matches_the_full_join_with_a_hot_key_nulls_and_nan(spark):
    rnd = random.Random(1)
    keys = ["a"] * 6 + ["b", "c", None]
    left = [(rnd.choice(keys), rnd.choice(["x", "y", None]), rnd.choice([1.5, 2.0, None, float("nan")]), 7, 0.0) for _ in range(120)]
    right = [(rnd.choice(keys), "q", rnd.choice([0.5, None, 4.0]), "clash") for _ in range(90)]
    assert run(spark, left, right) == brute(left, right)


def test_empty_sides(spark):
    one = [("a", "x", 1.0, 1, 1.0)]
    assert run(spark, [], []) == {} == run(spark, one, []) == run(spark, [], [("a", "h", 1.0, "")])


def test_full_join_keeps_rows_without_partner(spark):
    left = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), (None, "y")], "k string, g string")
    right = spark.createDataFrame([("a",), ("c",), ("c",), (None,)], "k string")
    s = eager.join_states(eager.compact(left, {"k": F.col("k"), "g": F.col("g")}), eager.compact(right, {"k": F.col("k")}), ["k"], "full")
    assert rows(eager.roll_up(s.filter("own_left > 0"), ["g"], own="left"), "g", "own_rows") == [("x", 2), ("y", 2)]
    assert rows(s.groupBy("k").agg(F.max("own_right").alias("n")).filter("n > 0"), "k", "n") == [(None, 1), ("a", 1), ("c", 2)]


def test_heavy_keys_are_inclusive(spark):
    t = spark.createDataFrame([("f", "a", 4), ("f", "b", 96), ("g", "c", 3), ("g", None, 97)], "field string, key string, n long")
    assert rows(eager.heavy_keys(t, "field", "key", "n", 0.04), "field", "key") == [("f", "a"), ("f", "b")]
