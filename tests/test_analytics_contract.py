import datetime

from tests.conftest import DATA
from yieldloom.operators import batchrisk, rootcause
from yieldloom.plans import analytics
from yieldloom.session import clean


def test_contract_has_lots_at_risk(spark):
    cause = "lot_id string, rank int, step string, tool_id string, parameter string, spatial_signature string, deviation_score double, confidence double, sample_size long, risk_score double, probability double, confidence_basis string, evidence string"
    ranked = spark.createDataFrame([(lot, r, "etch", "T", "p", "donut", 1.0, 1.0, 3, 0.5, None, "b", "e") for lot, r in [("A", 2), ("A", 1), ("B", 1)]], cause)
    risks = spark.createDataFrame([("X", 0.6, "donut", "A"), ("Z", 0.9, "random", "A"), ("Y", 0.9, "scratch", "B")], "lot_id string, risk_score double, matched_signature string, match string")
    got = {r.lot_id: r for r in rootcause.findings(ranked, risks, 2).collect()}
    assert [c.rank for c in got["A"].candidate_causes] == [1, 2]
    for r in got.values():
        assert [tuple(b) for b in r.at_risk_upcoming_batches] == [("Y", None, 0.9, "scratch"), ("Z", None, 0.9, "random")] and r.at_risk_total == 3
    assert rootcause.findings(ranked, risks.limit(0)).filter("size(at_risk_upcoming_batches) = 0 and at_risk_total = 0").count() == 2


def test_registered_contract_has_lots_at_risk(spark):
    want = sorted((-r.risk_score, r.lot_id) for r in analytics.batch_risk(spark, DATA).collect())
    got = analytics.root_cause_evidence(spark, DATA).collect()
    assert want and got
    for r in got:
        assert [(-b.risk_score, b.lot_id) for b in r.at_risk_upcoming_batches] == want[:100] and r.at_risk_total == len(want)


def test_signatures_are_made_once_for_the_ranking_and_the_lots_at_risk(spark, monkeypatch):
    made, real = [], analytics.spatial.signatures
    monkeypatch.setattr(analytics.spatial, "signatures", lambda *a: made.append(1) or real(*a))
    clean(spark)
    assert analytics.contract_causes(spark, DATA).count() and len(made) == 1


def test_last_readings_are_taken_once_and_blocks_hold_numbers(spark, monkeypatch):
    """Of the ranking and the lots at risk; a block of names takes four times the memory of one of numbers."""
    made, written, real, write = [], {}, rootcause.lot_sources, batchrisk.materialize
    monkeypatch.setattr(rootcause, "lot_sources", lambda *a: made.append(1) or real(*a))
    monkeypatch.setattr(batchrisk, "materialize", lambda df, name: written.update({name: dict(df.dtypes)}) or write(df, name))
    clean(spark)
    assert analytics.root_cause_evidence(spark, DATA).count() and len(made) == 1
    assert written["running"]["sources"] == written["history"]["old_sources"] == "array<int>"


def test_last_readings_and_first_limits(spark):
    """A null reading is a lot's last one but not its last value; the limits are those of the first reading, without a time the first; a source may lack a name."""
    ddl = "id long, lot_id string, step string, tool_id string, parameter string, value double, spec_min double, spec_max double, ts timestamp_ntz"
    t = [datetime.datetime(2026, 1, d) for d in (1, 2, 3)]
    rows = [(1, "A", "s", "T", "p", 1.0, 0.0, 9.0, t[1]), (2, "A", "s", "T", "p", 2.0, 0.0, 8.0, t[1]), (3, "A", "s", "T", "p", None, 0.0, 7.0, t[2]), (4, "B", "s", "T", "p", None, 0.0, 6.0, t[0]), (5, "B", "s", "T", "p", 5.0, 0.0, 5.0, t[1]),
            (6, "B", "s", None, "p", 5.0, 1.0, 5.0, t[0]), (7, "B", "s", None, "p", 5.0, 2.0, 6.0, None), (8, "C", "s", "T", "p", None, 0.0, 1.0, t[0])]
    steps = spark.createDataFrame(rows, ddl)
    lots = spark.createDataFrame([("A", "normal"), ("B", "affected")], "lot_id string, cohort string")
    base = rootcause.baselines(steps, lots)
    assert {r.tool_id: (r.n, r.spec_min, r.spec_max) for r in base.collect()} == {"T": (3, 0.0, 9.0), None: (2, 2.0, 6.0)}
    got = {r.lot_id: (r.value, r.last_value) for r in rootcause.lot_sources(steps, base).collect()}
    assert got == {"A": (None, 2.0), "B": (5.0, 5.0), "C": (None, None)}
    assert sorted(r.lot_id for r in batchrisk.fingerprints(rootcause.lot_sources(steps, base), base).collect()) == ["A", "B"]
