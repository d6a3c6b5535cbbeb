import random

from pyspark.sql import functions as F

from yieldloom.llm import topn

SCHEMA = "fid long, g string, s double, rank int, content string, id string"


def brute(data, n):
    once = {}
    for fid, *rest in sorted(data):
        once.setdefault(tuple("nan" if isinstance(x, float) and x != x else x for x in rest), fid)
    best = {}
    for (g, s, *_), fid in once.items():
        if g is not None and s is not None and s != "nan":
            best.setdefault(g, []).append((-s, fid))
    return {(g, f) for g, xs in best.items() for _, f in sorted(xs)[:n]}


def run(spark, data, n=3, partitions=3, batch=None):
    df = spark.createDataFrame(data, SCHEMA).repartition(partitions)
    return {(r.grp, r.id) for r in topn.top_n(df, {"grp": F.col("g")}, "fid", F.col("s"), n).collect()}


def sample(n, seed=0):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["hot"] * 6 + ["b", "c", "d", None]), rnd.choice([0.1, 0.5, 0.9, 0.9, None, float("nan")]), rnd.choice([1, None]), rnd.choice(["u", "v", None]), rnd.choice(["x", None])) for i in range(n)]


def test_ties_copies_nulls_and_a_hot_group(spark):
    for n in (1, 3, 50):
        data = sample(2_000, n)
        assert run(spark, data, n) == brute(data, n)


def test_copies_are_told_apart_from_rows_with_nulls_in_other_places(spark):
    data = [(1, "g", 0.5, None, "u", None), (2, "g", 0.5, None, None, "u"), (3, "g", 0.5, None, "u", None)]
    assert run(spark, data) == {("g", 1), ("g", 2)}


def test_groups_that_span_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        data = sample(500, 9)
        assert run(spark, data) == brute(data, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table_and_small_groups(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, "g", 0.0, 1, "", "")]) == {("g", 1)}
