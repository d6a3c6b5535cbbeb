import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from yieldloom.functions import text as fx
from yieldloom.operators import batchrisk, commonality, doe, excursions, lots as ops, outcome, retrieval, rootcause, spatial, spc, verify
from tests import generate
from yieldloom.sources import fab, sinks, tables
from yieldloom.streaming import spc as stream

STEPS = "id long, lot_id string, step string, tool_id string, parameter string, value double, spec_min double, spec_max double, ts timestamp_ntz"


def readings(spark, values, lo=None, hi=None, tool="T"):
    t = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id long, value double")
    f = lambda v: F.lit(v).cast("double")
    return t.select("id", F.lit("L").alias("lot_id"), F.lit("etch").alias("step"), F.lit(tool).alias("tool_id"), F.lit("p").alias("parameter"), "value", f(lo).alias("spec_min"), f(hi).alias("spec_max"),
                    F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"))


@pytest.mark.parametrize(("values", "lo", "hi", "low", "high"), [
    (np.random.default_rng(1).normal(50, 1, 1000), 44, 56, 1.85, 2.15), (np.random.default_rng(2).normal(54.5, 1, 500), 45, 55, -9, 1.33),
    ([10, 10.5, 9.5, 10.2, 9.8], None, 15, 1.33, 99), ([10, 10.5, 9.5, 10.2, 9.8], 5, None, 1.33, 99), ([10] * 3, 5, 15, 9.99, 9.99), ([20] * 3, 5, 15, 0, 0), ([20] * 3, None, 15, 0, 0),
])
def test_capability(spark, values, lo, hi, low, high):
    c = spc.key_stats(readings(spark, values, lo, hi)).first().cpk
    assert low <= c <= high


def test_capability_is_unknown_for_one_reading_or_without_limits(spark):
    assert spc.key_stats(readings(spark, [10], 5, 15)).first().cpk is None
    assert spc.key_stats(readings(spark, [10, 11, 12])).first().cpk is None
    assert spc.key_stats(readings(spark, [None, None], 5, 15)).count() == 0


@pytest.mark.parametrize(("values", "rule", "hits"), [
    ([10, 10.1, 9.9, 10, 10.2, 14.5, 10.1], "rule1", [5]), ([10, 10.1, 12.5, 10.2, 12.4], "rule2", [4]), ([10, 11.2, 11.5, 11.3, 11.4], "rule3", [4]),
    ([10.2, 10.3, 10.1, 10.4, 10.2, 10.5, 10.3, 10.2], "rule4", [7]), ([10, 10.1], "rule2", []),
])
def test_western_electric_rules(spark, values, rule, hits):
    s = readings(spark, values)
    chart = spc.control_chart(s, spc.key_stats(s).withColumn("mean", F.lit(10.0)).withColumn("sd", F.lit(1.0)))
    assert [r.id for r in chart.orderBy("id").collect() if r[rule]] == hits


def brute_rules(z):
    out = []
    for i in range(len(z)):
        f = [abs(z[i]) > 3]
        for last, least, limit in ((3, 2, 2), (5, 4, 1), (8, 8, 0)):
            w = z[i - last + 1 : i + 1] if i + 1 >= last else []
            f.append(len(w) == last and (sum(x > limit for x in w) >= least or sum(x < -limit for x in w) >= least))
        out.append(tuple(bool(x) for x in f))
    return out


def test_rules_over_chunks_and_on_a_stream_equal_brute_force(spark, tmp_path):
    y = np.random.default_rng(3).normal(0, 1, 600).cumsum() * 0.2 + np.random.default_rng(4).normal(0, 1, 600)
    s = readings(spark, [None, *y])
    stats = spc.key_stats(s)
    m = stats.first()
    want = brute_rules([(v - m.mean) / m.sd for v in y])
    for p in (1, 4):
        got = spc.control_chart(s, stats, partitions=p).orderBy("id").collect()
        assert [(r.rule1, r.rule2, r.rule3, r.rule4) for r in got] == want
    path = str(tmp_path / "in")
    for a, b in ((0, 200), (200, 203), (203, 700)):
        s.filter((F.col("id") >= a) & (F.col("id") < b)).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = stream.control_chart(src, stats).writeStream.format("memory").queryName("chart").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("chart").orderBy("id").collect()
    assert [(r.rule1, r.rule2, r.rule3, r.rule4) for r in got] == want


def test_window_rates_on_a_stream_equal_the_batch(spark, tmp_path):
    s = readings(spark, [None, *range(100)], 10, 80)
    s.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
    q = stream.rates(src, window="20 seconds").writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("rates").agg(F.count(F.lit(1)).alias("windows"), F.sum("readings").alias("n"), F.sum("out_of_spec").alias("out")).first()
    assert tuple(got) == (6, 101, 10 + 19)


def test_shapes_of_generated_wafers(spark):
    w = spark.createDataFrame([(f"L{i}-{s}", "W", s) for s in generate.SHAPES for i in range(8)], "lot_id string, wafer_id string, shape string")
    d = generate.defects(w, 60, seed=5)
    assert d.filter("x * x + y * y > 1.0001").count() == 0
    got = spatial.signatures(d.select("lot_id", "x", "y")).collect()
    right = [r.lot_id.split("-", 1)[1] for r in got if r.signature == r.lot_id.split("-", 1)[1]]
    assert len(got) == 40 and all(right.count(s) == 8 for s in generate.SHAPES[:4]) and right.count("random") >= 4  # uniform points may look like a ring


def test_few_points_are_random_and_degenerate_clouds_have_no_span(spark):
    pts = [("a", 0.9, 0.0)] * 3 + [("b", 0.1, 0.1)] * 5 + [("c", x / 10, 0.0) for x in range(-5, 6)]
    got = {r.lot_id: r for r in spatial.signatures(spark.createDataFrame(pts, "lot_id string, x double, y double")).collect()}
    assert got["a"].signature == "random" and got["a"].confidence == 0.5
    assert got["b"].signature == "center-cluster" and got["b"].span == 0
    assert got["c"].signature == "scratch" and abs(got["c"].span - 1.0) < 1e-9
    assert spatial.signatures(spark.createDataFrame([], "lot_id string, x double, y double")).count() == 0


def fisher(a, b, c, d):
    n, k, m = a + b + c + d, a + c, a + b
    pmf = lambda x: math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m) if 0 <= m - x <= n - k else 0.0
    return min(1.0, sum(p for p in map(pmf, range(min(k, m) + 1)) if p <= pmf(a) + 1e-12))


def test_fisher_equals_exact_sums(spark):
    rnd = random.Random(6)
    tables = [(10, 0, 0, 10), (5, 5, 5, 5), (8, 2, 2, 8), (0, 5, 0, 5), (0, 0, 3, 4)] + [tuple(rnd.randint(0, 60) for _ in range(4)) for _ in range(40)]
    t = spark.createDataFrame([(i, *x) for i, x in enumerate(tables)], "k int, a long, b long, c long, d long")
    for r in commonality.fisher(t).collect():
        want = 1.0 if 0 in (r.a + r.c, r.a + r.b) else fisher(r.a, r.b, r.c, r.d)
        assert abs(r.p_value - want) < 1e-9
    x = t.filter("k < 2").select(commonality.odds_ratio().alias("o"), commonality.relative_risk().alias("r")).collect()
    assert [tuple(v) for v in x] == [(9999.0, 9999.0), (1.0, 1.0)]


@pytest.fixture(scope="module")
def line(spark):
    raw = generate.lots(spark, 160, seed=1)
    steps = fab.steps_of(generate.telemetry(raw, seed=2)).cache()
    lots = fab.lots_of(raw).cache()
    wafers = raw.filter("drifted").select("lot_id", F.lit("W").alias("wafer_id"), F.lit("edge-ring").alias("shape"))
    return raw, lots, steps, fab.defects_of(generate.defects(wafers, 40, seed=3)).cache()


def test_the_injected_cause_ranks_first(spark, line):
    raw, lots, steps, defects = line
    ranked = rootcause.rank_causes(lots, steps, defects).cache()
    labels = raw.filter("drifted and status = 'completed'").select(
        "lot_id", F.lit("etch").alias("injected_cause_step"), F.lit("etch-02 ").alias("injected_cause_tool_id"), F.lit("etch_1").alias("injected_cause_parameter"))
    a = outcome.accuracy(outcome.hits(ranked, labels)).first()
    assert a.lots == labels.count() and a.top1 > 0.9 and a.passed
    first = ranked.filter("rank = 1").join(labels, "lot_id").first()
    assert first.spatial_signature == "edge-ring" and "etch_1 at ETCH-02 deviates by +" in first.evidence and first.probability is None
    assert ranked.join(labels, "lot_id").select("step").distinct().count() == 1  # narrowed to the step of the defects
    r = outcome.recovery(ranked, lots)
    total = outcome.total_recovery(r).join(lots, "lot_id").collect()
    assert all(t.recoverable <= t.gap + 1e-9 for t in total)


def test_best_matches_in_blocks_equal_brute_force(spark, line):
    _, lots, steps, _ = line
    z = batchrisk.fingerprints(steps, rootcause.baselines(steps, lots)).cache()
    parts = [z.join(lots.filter(c), "lot_id", "left_semi") for c in ("status = 'in_progress'", "cohort = 'affected'")]
    a, b = ({k: dict(v) for k, v in by(p).items()} for p in parts)
    for block in (7, 1000):
        got = {r.lot_id: (r.match, r.similarity) for r in batchrisk.best_matches(*parts, block=block).collect()}
        assert set(got) == set(a)
        for lot, own in a.items():
            scored = []
            for name, old in b.items():
                keys = set(own) & set(old)
                if keys:
                    sim = math.exp(-math.sqrt(sum((own[k] - old[k]) ** 2 for k in keys) / len(keys)) / 2)
                    scored.append((-round(sim if any(abs(own[k]) >= 1.5 for k in keys) else sim * 0.2, 9), name))
            assert got[lot][0] == min(scored)[1] and abs(got[lot][1] + min(scored)[0]) < 1e-8


def by(fingerprint):
    out = {}
    for r in fingerprint.collect():
        out.setdefault(r.lot_id, []).append((r.source, r.z))
    return out


def test_experiments_have_every_corner_and_a_permuted_order(spark, line):
    _, lots, steps, defects = line
    first = rootcause.rank_causes(lots, steps, defects).filter("rank = 1")
    runs = doe.runs(doe.factors(first, doe.factor_levels(steps))).filter("lot_id = 'LOT-0000001'").collect()
    by = {}
    for r in runs:
        by.setdefault(r.run, {})[r.factor] = r
    assert len(by) == 11 and sorted({r.run_order for r in runs}) == list(range(1, 12))
    assert len({tuple(v[f].coded for f in sorted(v)) for v in by.values() if v[0].type == "corner"}) == 8
    lv = doe.factor_levels(steps).collect()
    assert all(r.low <= r.nominal <= r.high for r in lv)


def test_fisher_of_large_margins():
    assert abs(commonality.two_sided(500_300, 499_700, 500_000, 500_000) - 0.6717) < 1e-3  # about normal: z = 0.424
    assert commonality.two_sided(10**9, 0, 0, 10**9) < 1e-8 and commonality.two_sided(5, 10**9, 0, 10**9) > 0.05


def test_excursions(spark):
    s = readings(spark, [10.0, 14.0, None, 10.5, 6.0], 7, 13)
    t = excursions.leading(excursions.excursion_scores(s)).orderBy("rank").collect()
    assert [r.id for r in t] == [1, 4, 3] and abs(sum(r.probability for r in t) - 1) < 1e-9


def test_last_write_wins_and_first_limits(spark):
    s = spark.createDataFrame([(1, "L", "s", "t", "p", 1.0, 0.0, 5.0, 10), (2, "L", "s", "t", "p", 2.0, 1.0, 6.0, 10), (3, "L", "s", "t", "p", 9.0, 2.0, 7.0, 5)], STEPS.replace("ts timestamp_ntz", "ts int"))
    assert ops.latest(s).first().value == 2.0
    assert tuple(ops.first_limits(s).first())[3:] == (2.0, 7.0)
    assert ops.latest(s.limit(0)).count() == 0


def test_retrieval_order_and_empty_queries(spark):
    docs = spark.createDataFrame([(1, "etch chamber pressure drift and etch clean", "etch"), (2, "litho focus offset", "litho"), (3, "", "cmp"), (4, "chamber notes", None)], "id long, text string, step string")
    q = spark.createDataFrame([("a", "etch chamber pressure"), ("b", ""), ("c", "focus focus"), ("d", "zzz")], "query_id string, text string")
    got = retrieval.hybrid(docs, q)
    assert rows(got.filter("rank = 1"), "query_id", "id") == [("a", 1), ("c", 2)]
    b = {(r.query_id, r.id): r.bm25 for r in retrieval.bm25(retrieval.build_index(docs), q).collect()}
    mean = (7 + 3 + 0 + 2) / 4
    assert abs(b["c", 2] - 2 * math.log(3.5 / 1.5 + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / mean))) < 1e-9
    assert {r.query_id for r in retrieval.grade(got, docs, q).filter("grade = 'relevant'").collect()} >= {"a"}
    assert retrieval.merge(got.withColumn("question", F.lit(1)), "question", 2).count() == 2


def test_rules_and_rewriting(spark):
    t = spark.createDataFrame([("Why did the lot fail?",), ("hello",), ("CP of etch-7x and etch-07, lithography RF power",), (None,)], "t string")
    got = t.select(fx.first_rule(F.col("t"), fx.INTENTS, "general").alias("i"), fx.rewrite(F.col("t"), {"cp": "chamber_pressure", "RF power": "rf_power_forward"}).alias("r"), fx.tokens(F.col("t")).alias("k")).collect()
    assert [r.i for r in got] == ["root_cause", "general", "general", "general"]
    assert got[2].r == "chamber_pressure of etch-7x and etch-07, lithography rf_power_forward" and got[3].r is None and got[3]["k"] == []


def test_claims(spark):
    texts = spark.createDataFrame([(1, "L", "ETCH-07 at 99.9 sigma, Cpk 0.82, risk score 0.7"), (2, "L", ""), (3, None, "7.1 sigma"), (4, "L", None), (5, "M", "IMPLANT-99 Cpk=0.4")], "id long, lot_id string, text string")
    refs = spark.createDataFrame([("L", [4.2], [0.8], [0.9], ["ETCH-07"]), ("M", [], [], [], ["IMP-01"])], "lot_id string, sigmas array<double>, cpks array<double>, scores array<double>, tools array<string>")
    c = verify.check(verify.claims(texts), refs)
    assert rows(c, "id", "kind", "grounded") == [(1, "cpk", True), (1, "risk_score", False), (1, "sigma", False), (1, "tool", True), (3, "sigma", False), (5, "cpk", True), (5, "tool", False)]
    g = {r.id: (r.claims, r.rate, r.passed) for r in verify.grounding(texts, c).collect()}
    assert g == {1: (4, 0.5, False), 2: (0, 1.0, True), 3: (1, 0.0, False), 4: (0, 1.0, True), 5: (2, 0.5, False)}
    m = {r.id: r.marked for r in verify.mark(texts, c).collect()}
    assert m[1] == "ETCH-07 at [UNVERIFIED: 99.9] sigma, Cpk 0.82, risk score [UNVERIFIED: 0.7]" and m[2] == "" and m[4] is None


def test_writers(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n int")
    folder = str(tmp_path / "db")
    assert sinks.write_version({"t": a, "u": a.limit(0)}, folder) == {"t": 2, "u": 0}
    before = sinks.current(spark, folder)
    changed = sinks.upsert(tables.table(spark, before, "t"), spark.createDataFrame([("y", 5), ("z", 6)], "k string, n int"), ["k"])
    assert sinks.write_version({"t": changed}, folder) == {"t": 3}
    assert rows(tables.table(spark, before, "t")) == [("x", 1), ("y", 2)]
    t = tables.table(spark, sinks.current(spark, folder), "t")
    assert rows(t) == [("x", 1), ("y", 5), ("z", 6)]
    assert rows(sinks.update(t, F.col("k") == "x", n=F.col("n") + 1)) == [("x", 2), ("y", 5), ("z", 6)]
    assert rows(sinks.delete(t, t.filter("n > 4").select("k"))) == [("x", 1)]
    log = f"{folder}/log"
    assert sinks.append(a.repartition(3), log) == 2 and sinks.append(a, log) == 4
    assert sorted(r.id for r in spark.read.parquet(log).collect()) == [1, 2, 3, 4]
    sinks.export(a, f"{folder}/csv", "csv")
    assert spark.read.option("header", True).csv(f"{folder}/csv").count() == 2
    assert sinks.first_existing(spark, [f"{folder}/none", log]) == log
    with pytest.raises(FileNotFoundError):
        sinks.first_existing(spark, [f"{folder}/none"])
    assert tables.optional_table(spark, f"{folder}/none", "a int").count() == 0
    (tmp_path / "kb.json").write_text('[{"a": 1, "b": ["x"]}, {"a": 2}]')
    assert rows(sinks.json_documents(spark, str(tmp_path / "kb.json"), "a int, b array<string>"), "a") == [(1,), (2,)]
