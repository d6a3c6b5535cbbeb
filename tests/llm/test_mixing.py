import random
from collections import Counter

from pyspark.sql import functions as F

from yieldloom.llm import mixing

ITEMS, WEIGHTS = "source string, id long, size long, rank string, copy string", "source string, target_share double, max_repeats int"


def run(spark, items, weights, **more):
    i, w = spark.createDataFrame([(*x, "clash", "") for x in items], ITEMS), spark.createDataFrame(weights, WEIGHTS)
    m = mixing.mix(i, w, **more).cache()
    return m.collect(), {r.source: r for r in mixing.shares(m, w).collect()}


def sample(n=6_000):
    rnd = random.Random(8)
    return [(rnd.choice(["web"] * 7 + ["log", "log", "law"]), i, int(rnd.lognormvariate(3, 1)) + 1) for i in range(n)]


def test_shares_are_reached_within_the_repeats(spark):
    mixed, got = run(spark, sample(), [("web", 0.5, 1), ("log", 0.3, 3), ("law", 0.2, 4)])
    assert all(abs(r.share - r.target_share) < 0.01 for r in got.values())
    times = Counter((r.source, r.id) for r in mixed)
    assert all(n <= {"web": 1, "log": 3, "law": 4}[s] for (s, _), n in times.items())
    per = {s: {n for (t, _), n in times.items() if t == s} for s in ("log", "law")}
    assert all(max(x) - min(x) <= 1 for x in per.values())  # expected copies, rounded up or down
    assert len({(r.source, r.id, r.copy) for r in mixed}) == len(mixed)


def test_capped_sources_fall_short_and_say_so(spark):
    mixed, got = run(spark, sample(), [("web", 0.1, 1), ("law", 0.9, 2)], total=1e9)
    assert {r.id for r in mixed} == {i for s, i, _ in sample() if s in ("web", "law")}
    assert got["law"].share < 0.9 and got["law"].most_copies == 2


def test_ranks_equal_sorting_each_source(spark):
    items = sample(500)
    want = {i: k for s in ("web", "log", "law") for k, (_, i) in enumerate(sorted((n, i) for t, i, n in items if t == s), 1)}
    r = mixing.ranked(spark.createDataFrame([(*x, "", "") for x in items], ITEMS), 5)
    assert {x.id: x["rank"] for x in r.collect()} == want


def test_missing_sources_nulls_and_empty_tables(spark):
    items = [("a", 1, 10), ("a", 2, 10), (None, 3, 10), ("zz", 4, 10), ("a", 5, None), ("a", 6, 0), ("a", None, 9)]
    mixed, got = run(spark, items, [("a", 0.6, 2), ("none", 0.4, 3)])
    assert sorted((r.id, r.copy) for r in mixed) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert got["a"].share == 1.0 and got["none"].size == 0 and got["none"].share == 0
    mixed, got = run(spark, [], [("a", 1.0, 2)])
    assert mixed == [] and got["a"].share == 0
