import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldloom.llm.percentiles import Compactors, build_sketches, merge_sketches, percentiles, rank_error

AT = [0.1, 1.0, 50.0, 99.0, 99.9]


def off(values, estimate, share):
    """Distance of the estimate's rank from the wanted one, relative to the nearer end."""
    n = len(values)
    want = max(1, np.ceil(share * n - 1e-9))
    low, high = (values < estimate).sum() + 1, (values <= estimate).sum()
    return max(low - want, want - high, 0) / min(want, n + 1 - want)


@pytest.mark.parametrize("shape", ["normal", "lognormal", "few"])
def test_rank_error_of_merged_parts_is_relative_to_the_protected_end(shape):
    rng = np.random.default_rng(5)
    values = {"normal": rng.normal(size=300_000), "lognormal": rng.lognormal(0, 3, 300_000), "few": rng.integers(0, 9, 300_000).astype(float)}[shape]
    total = Compactors()
    for part in np.array_split(values, 40):
        s = Compactors()
        for piece in np.array_split(part, 3):
            s.add(piece)
        total.merge(Compactors.from_bytes(s.to_bytes()))
    assert total.n == len(values) and sum(map(len, total.levels)) < 12_000
    for share in (1e-5, 1e-4, 1e-3, 0.01, 0.1, 0.5):
        assert off(values, total.quantiles(np.array([share]))[0], share) <= rank_error()


def test_weights_add_up_and_small_sets_are_exact():
    s = Compactors()
    s.add(np.arange(100.0))
    assert list(s.quantiles(np.array([0.01, 0.5, 1.0]))) == [0.0, 49.0, 99.0]
    s.add(np.random.default_rng(0).random(50_000))
    assert sum(len(x) << h for h, x in enumerate(s.levels)) == s.n


def run(spark, data, keys=("k",), partitions=5, **more):
    df = spark.createDataFrame([(*x, "clash", 1) for x in data], "k string, day int, v double, n string, part int").repartition(partitions)
    states = build_sketches(df, {"k": F.col("k"), "day": F.col("day")}, F.col("v"), **more)
    return percentiles(merge_sketches(states, keys, partitions, fan=2), list(keys), AT)


def test_states_of_days_and_partitions_combine(spark):
    rng = np.random.default_rng(1)
    values = {"hot": rng.normal(size=30_000), "cold": np.array([3.0])}
    data = [(k, i % 7, float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    got = run(spark, data, batch=2_000, most=1).collect()
    assert {(r.k, r.n) for r in got} == {("hot", 30_000), ("cold", 1)}
    for r in got:
        assert off(values[r.k], r.value, r.pct / 100) <= r.rank_error + 1 / 30
    by_day = run(spark, data, ("k", "day"))
    assert by_day.count() == 8 * len(AT)


def test_nulls_nan_infinities_and_empty_tables(spark):
    data = [("a", 0, None), ("a", 0, float("nan")), ("a", 0, float("inf")), ("a", 0, 1.0), ("a", 0, 1.0), (None, 0, 5.0), ("b", 0, None)]
    got = {r.pct: (r.k, r.n, r.value) for r in run(spark, data).collect()}
    assert got == {0.1: ("a", 3, 1.0), 1.0: ("a", 3, 1.0), 50.0: ("a", 3, 1.0), 99.0: ("a", 3, float("inf")), 99.9: ("a", 3, float("inf"))}
    assert run(spark, []).count() == 0
