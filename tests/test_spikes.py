import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from yieldloom.operators import spikes

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "id long, tool string, par string, ts timestamp_ntz, v double, seam string, h string"


def series(n=400, seed=0, level=20.0, sd=0.3):
    rng = np.random.default_rng(seed)
    return (level + np.cumsum(rng.normal(0, sd / 30, n)) + rng.normal(0, sd, n)).round(3)


def table(values, tool="T1", first=0, step=1):
    return [(first + i, tool, "p", T0 + dt.timedelta(minutes=i * step), None if v is None else float(v), "x", "y") for i, v in enumerate(values)]


def flags(spark, data, partitions=None, **config):
    df = spark.createDataFrame(data, SCHEMA)
    t = spikes.flag_readings(df, "id", F.col("tool"), F.col("par"), "ts", "v", spikes.SpikeConfig(**config), partitions)
    got = t.collect()
    assert len(got) == len({r.id for r in got})
    return {r.id: r.kind for r in got}


def test_spikes_alone_and_in_a_row_stuck_runs_and_impossible_values(spark):
    y = series()
    y[50] += 5
    y[100:103] -= 6
    y[200:210] = y[200]
    y[300] = 1e9
    y[310:] += 4  # a lasting change of level
    want = {50: "spike", 100: "spike", 101: "spike", 102: "spike", 300: "impossible"} | {i: "stuck" for i in range(200, 210)}
    assert flags(spark, table(y)) == want


def test_seams_between_partitions_and_chunks_change_nothing(spark):
    data, want = [], {}
    for k, n in enumerate((3000, 900, 150, 30)):
        y = series(n, seed=k)
        for i in range(7, n - 5, 37):
            y[i] += 6
        y[10:18] = y[10]
        data += table(y, f"T{k}", 10_000 * k)
    whole = flags(spark, data, 1)
    assert len(whole) > 80
    for p in (2, 5):
        assert flags(spark, data, p) == whole
    assert flags(spark, data, 1, chunk=300) == whole


def test_a_source_whose_scatter_changes_is_judged_alike_however_it_is_cut(spark):
    rng = np.random.default_rng(9)
    data, every = [], []
    for k, n in enumerate((4000, 700, 258)):
        y = 20 + rng.normal(0, 1, n) * np.repeat([1.0, 3.0], [n // 2, n - n // 2])
        y[n // 3 : n // 3 + 2] += 12
        y[3 * n // 4] -= 30
        every.append(y)
        data += table(y.round(2), f"T{k}", 10_000 * k)
    whole = flags(spark, data, 1)
    assert len(whole) > 6
    for p in (2, 7):
        assert flags(spark, data, p) == whole
    assert flags(spark, data, 1, chunk=300) == whole == flags(spark, data, 3, chunk=300)


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    y = series(900, 5)
    y[70:800:90] += 6
    data = table(y) + table(y[:100], "T2", 5_000)
    want = flags(spark, data, 1)
    monkeypatch.setattr(spikes, "BROADCAST_SOURCES", 0)
    assert len(want) == 10 and flags(spark, data, 3) == want


def test_measures_add_up_over_any_cut(spark):
    c = spikes.SpikeConfig()
    y = np.r_[series(500, 3), [5.0] * 9, series(200, 4)].clip(None, 1e100)
    whole = spikes.measure(y, 0, len(y), c)
    parts = [spikes.measure(y, a, b, c) for a, b in ((0, 100), (100, 505), (505, len(y)))]
    assert whole[1:] == tuple(sum(p[i] for p in parts) for i in (1, 2))
    assert whole[0] == {k: sum(p[0].get(k, 0) for p in parts) for k in whole[0]}
    d = np.abs(np.diff(y))[(spikes.run_lengths(y)[1:] < 3) | (np.diff(y) != 0)]
    cells = np.repeat(list(whole[0]), list(whole[0].values()))
    s = spark.range(1).select(spikes.scatter(F.lit(int(np.sort(cells)[(len(cells) - 1) // 2])), c)).first()[0]
    assert abs(s / (1.4826 * np.median(d) / np.sqrt(2)) - 1) < 0.02


def test_copies_share_the_verdict_and_do_not_lengthen_runs(spark):
    y = series(60)
    y[20] += 6
    y[40:47] = y[40]  # seven equal readings
    data = table(y)
    data += [(1000 + i, *data[i][1:]) for i in (20, 41, 42)]
    assert flags(spark, data) == {20: "spike", 1020: "spike"}


def test_nulls_short_sources_and_empty_tables(spark):
    y = [*series(19)]
    y[9] = 99.0
    assert flags(spark, table(y)) == {}
    values = [None, float("nan"), *y, 20.0, None]
    data = table(values) + [(900, None, "p", T0, 1.0, "x", "y"), (901, "T1", None, T0, 1.0, "x", "y"), (902, "T1", "p", None, 1.0, "x", "y")]
    assert set(flags(spark, data)) == {11}
    assert flags(spark, []) == {}


def test_constant_and_infinite_readings(spark):
    assert flags(spark, table([5.0] * 7 + [6.0] * 7 + [5.0] * 7)) == {}
    y = series(40)
    y[5], y[20] = float("inf"), float("-inf")
    assert flags(spark, table(y)) == {5: "impossible", 20: "impossible"}
