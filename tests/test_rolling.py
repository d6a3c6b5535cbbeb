import datetime as dt
import random

from pyspark.sql import functions as F

from yieldloom.operators import rolling

DAY0 = dt.datetime(2026, 1, 1, 12)


def brute(data, p):
    out = {}
    for e in {x[0] for x in data if x[0] is not None and x[1] is not None}:
        own = [(t.date(), v) for x, t, v in data if x == e and t is not None]
        d, last = min(a for a, _ in own), max(a for a, _ in own)
        while d <= last:
            near = [v for a, v in own if d - dt.timedelta(p - 1) <= a <= d]
            good = [v for v in near if v is not None and 0 <= v <= 100]
            out[e, d] = (len(near), len(good), round(sum(good), 6))
            d += dt.timedelta(1)
    return out


def run(spark, data, top, periods=(7, 30)):
    df = spark.createDataFrame([(*x, "late", 1) for x in data], "e string, t timestamp_ntz, v double, day string, level int")
    v = F.col("v")
    return rolling.rolling_totals(df, F.col("e"), F.col("t"), v, F.coalesce(~F.isnan(v) & v.between(0, 100), F.lit(False)), periods, top)


def sample(n=300):
    rnd = random.Random(3)
    return [
        (rnd.choice(["A"] * 5 + ["B", "C", None]), rnd.choice([DAY0 + dt.timedelta(rnd.randrange(150), rnd.randrange(3600))] * 9 + [None]), rnd.choice([rnd.uniform(60, 100), None, float("nan"), 999.0, 100.0]))
        for _ in range(n)
    ]


def test_matches_brute_force_for_any_shard_size(spark):
    data = sample()
    for top in (1, 3, 6):
        got = run(spark, data, top).collect()
        for p in (7, 30):
            assert {(r.entity, r.day): (r[f"records_{p}"], r[f"values_{p}"], round(r[f"total_{p}"], 6)) for r in got} == brute(data, p)


def test_means_are_null_without_a_value_and_the_table_may_be_empty(spark):
    r = run(spark, [("A", DAY0, None)], 6).collect()
    assert [(x.records_7, x.values_7, x.mean_7) for x in r] == [(1, 0, None)]
    assert run(spark, [], 6).count() == 0


def test_late_records_change_only_ancestors(spark):
    data = [x for x in sample() if x[0] and x[1]]
    ok = F.coalesce(~F.isnan("v") & F.col("v").between(0, 100), F.lit(False))
    days = lambda d: rolling.daily(spark.createDataFrame(d, "e string, t timestamp_ntz, v double"), F.col("e"), F.col("t"), F.col("v"), ok)
    tree, late = rolling.build_trees(days(data[:-3])), days(data[-3:])
    changed = rolling.corrected_nodes(tree, late)
    assert changed.count() <= 3 * (rolling.TOP + 1)
    key = lambda t: sorted((r.entity, r.level, r.node, r.records, r["values"], round(r.total, 6)) for r in t.collect())
    assert key(rolling.apply_corrections(tree, late)) == key(rolling.build_trees(days(data)))
