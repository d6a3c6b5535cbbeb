"""Claims against references and retrieval, on small tables made for what they check."""

from pathlib import Path

from pyspark.sql import functions as F

from tests.conftest import DATA, rows
from yieldloom.operators import retrieval, verify
from yieldloom.plans import texts

FINDINGS = "finding_id long, lot_id string, probability double, risk_score double, evidence string"


def test_score_claims_of_registered_queries(spark, tmp_path):
    for p in Path(DATA).glob("*.parquet"):
        if p.stem != "mock_findings":
            (tmp_path / p.name).symlink_to(p)
    nan = float("nan")
    found = [
        (1, "A", None, 0.80, "risk score 0.81"), (2, "A", 0.30, nan, "score of 0.50"), (3, "A", 7.0, None, "Risk score 0.34, score 7"),
        (4, "B", nan, None, "risk score 0.5"), (5, "C", None, None, None), (6, None, 0.1, None, "score 0.9"),
    ]
    spark.createDataFrame(found, FINDINGS).write.parquet(str(tmp_path / "mock_findings.parquet"))
    assert rows(texts.evidence_claims(spark, str(tmp_path)), "id", "word", "grounded") == [(1, "0.81", True), (2, "0.50", False), (3, "0.34", True), (4, "0.5", True), (6, "0.9", True)]
    assert rows(texts.evidence_grounding(spark, str(tmp_path)).filter("not passed"), "id", "claims", "grounded", "rate") == [(2, 1, 0, 0.0)]
    assert texts.evidence_marked(spark, str(tmp_path)).filter("id = 2").first().marked == "score of [UNVERIFIED: 0.50]"


def test_kept_scores_decide_as_all_do(spark):
    every = spark.range(0, 20_000).select(F.lit("L").alias("lot_id"), (F.rand(1) * 0.4).alias("risk_score"), (F.rand(2) * 0.1 + 0.6).alias("probability"))
    kept = verify.score_references(every)
    assert kept.select(F.size("scores").alias("n")).first().n <= 104
    asked = spark.range(0, 1001).select("id", F.lit("L").alias("lot_id"), F.lit("risk_score").alias("kind"), F.lit("w").alias("word"), (F.col("id") / 1000).alias("value"))
    none = F.array().cast("array<double>")
    refs = lambda t: t.select("lot_id", none.alias("sigmas"), none.alias("cpks"), "scores", F.array().cast("array<string>").alias("tools"))
    all_of = every.select("lot_id", F.explode(F.array("risk_score", "probability")).alias("v")).groupBy("lot_id").agg(F.collect_list("v").alias("scores"))
    got = rows(verify.check(asked, refs(kept)), "id", "grounded")
    assert got == rows(verify.check(asked, refs(all_of)), "id", "grounded") and {g for _, g in got} == {True, False}


DOCS = "id long, text string, step string, parameter string, signatures array<string>"
CAUSES = "query_id string, step string, tool_id string, parameter string, spatial_signature string"


def knowledge(spark):
    rows_ = [
        (1, "gas lines", "etch", "chamber_pressure", ["edge-ring", "Donut"]), (2, "gas lines", "litho", "focus_offset", []), (3, "gas lines of etch-07", None, None, None),
        (4, "unlike", "cvd", "chamber_pressure", ["scratch"]), (5, None, "cmp", "", [""]),
    ]
    docs = spark.createDataFrame(rows_, DOCS)
    q = spark.createDataFrame([("a", "gas"), ("b", "chamber_pressure and edge-ring"), ("c", ""), ("d", "zzz")], "query_id string, text string")
    causes = [("a", "Etch", " etch-07", "chamber_pressure", "donut"), ("a", "etch", "ETCH-07", "", "donut"), ("c", "etch", "", "chamber_pressure", ""), ("d", "cvd", None, "chamber_pressure", "scratch")]
    return docs, q, spark.createDataFrame(causes + [("a", "x", "ZZ-99", "y", "z")] * 2, CAUSES)


def test_boosts_of_parameters_signatures_and_causes(spark):
    docs, q, causes = knowledge(spark)
    pairs = retrieval._facts(docs, causes).crossJoin(retrieval._asked(q, causes)).withColumn("boost", F.round(retrieval.domain_boost(), 6)).filter("boost > 0")
    assert rows(pairs, "query_id", "id", "boost") == [
        ("a", 1, 0.65), ("a", 3, 0.4), ("a", 4, 0.15), ("b", 1, 0.35), ("b", 4, 0.2), ("c", 1, 0.3), ("c", 4, 0.15), ("d", 1, 0.15), ("d", 4, 0.4),
    ]
    got = retrieval.hybrid(docs, q, causes=causes)
    assert rows(got, "query_id", "rank", "id") == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("a", 4, 4), ("b", 1, 1), ("b", 2, 4), ("d", 1, 4), ("d", 2, 1)]
    assert rows(got.filter("method = 'domain_boost'"), "query_id", "id") == [("a", 1), ("a", 3), ("b", 1), ("d", 4)]
    many = causes.unionByName(spark.createDataFrame([("b", "etch", "ZZ-99", "chamber_pressure", "donut")] * 9, CAUSES))
    assert abs(retrieval.hybrid(docs, q, causes=many).filter("query_id = 'b' and id = 1").first().score - 0.3) < 1e-9
    step = q.withColumn("step_filter", F.when(F.col("query_id") == "a", "Litho"))
    assert rows(retrieval.hybrid(docs, step, causes=causes), "query_id", "id") == [("a", 2), ("b", 1), ("b", 4), ("d", 1), ("d", 4)]


def test_rerank(spark):
    docs, _, causes = knowledge(spark)
    results = docs.drop("text").crossJoin(spark.createDataFrame([("a",)], "query_id string")).withColumn("score", F.lit(0.1))
    q = spark.createDataFrame([("a", "Chamber pressure in etch", "CVD")], "query_id string, text string, finding_step string")
    assert rows(retrieval.rerank(results, q), "rank", "id", "score") == [(1, 1, 0.9), (2, 4, 0.8), (3, 2, 0.1)]
    assert rows(retrieval.rerank(results, q, 5, causes), "rank", "id", "score") == [(1, 1, 1.45), (2, 4, 1.05), (3, 2, 0.1), (4, 3, 0.1), (5, 5, 0.1)]


def test_grades_with_findings_promotion_and_fallback(spark):
    docs, q, causes = knowledge(spark)
    results = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("b", 2, 0.2), ("b", 3, 0.1), ("c", 2, 0.1)], "query_id string, id long, score double")
    g = retrieval.grade(results.filter("query_id <> 'a' or id = 1"), docs.withColumn("text", F.lit("-")), q, causes)
    assert rows(g, "query_id", "id", "grade", "used") == [("a", 1, "relevant", True), ("b", 2, "partial", True), ("b", 3, "irrelevant", False), ("c", 2, "irrelevant", False)]
    assert rows(retrieval.grade(results, docs.withColumn("text", F.lit("-")), q), "query_id", "id", "used")[:2] == [("a", 1, True), ("a", 2, True)]
    assert rows(retrieval.query_grades(g, q)) == [("a", "relevant", False), ("b", "partial", False), ("c", "irrelevant", True), ("d", "irrelevant", True)]


def test_weighted_fields(spark):
    t = spark.createDataFrame([(7, "gas", "etch", ["donut", "ring"])], "id long, title string, step string, signatures array<string>")
    assert t.select(retrieval.weighted_text(t).alias("w")).first().w == "gas gas gas etch etch etch donut ring donut ring 7"
    assert t.select(retrieval.weighted_text(t, {"step": 3}, "").alias("w")).first().w == "etchetchetch"


def test_score_claims_equal_the_sql(spark, tmp_path):
    import duckdb

    from yieldloom.plans import registry

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        if p.stem != "mock_findings":
            (tmp_path / p.name).symlink_to(p)
    con.execute(f"COPY (SELECT * REPLACE (CASE finding_id % 3 WHEN 0 THEN 'risk score 0.5' WHEN 1 THEN 'Score of 0.93, score 0.07' ELSE evidence END AS evidence) FROM '{DATA}/mock_findings.parquet') TO '{tmp_path}/mock_findings.parquet'")
    for p in tmp_path.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = rows(texts.evidence_claims(spark, str(tmp_path)), "id", "kind", "place", "word", "grounded")
    want = con.execute(f"SELECT id, kind, place, word, grounded FROM ({registry.ORACLE['evidence_claims']})").fetchall()
    assert got == sorted(tuple(r) for r in want)
    assert {g for _, kind, _, _, g in got if kind == "risk_score"} == {True, False}


def test_cause_queries_and_stubs(spark):
    docs, _, causes = knowledge(spark)
    q = retrieval.cause_queries(causes.limit(1), "query_id")
    assert rows(q) == [("a", "Etch  etch-07 chamber pressure donut", "Etch")]
    assert {r.id for r in retrieval.hybrid(docs, q, causes=causes).collect()} == {1}
    stubs = spark.createDataFrame([(9, "new"), (1, "known"), (None, "no id")], "id long, text string")
    assert {r.id for r in retrieval.with_stubs(docs, stubs).collect()} == {1, 2, 3, 4, 5, 9}
