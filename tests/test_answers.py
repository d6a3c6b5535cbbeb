from pyspark.sql import functions as F

from yieldloom.operators import answers


def test_scope_and_probability_claims(spark):
    t = spark.createDataFrame([("The probability is 78 %, yield rose 12.5 % and 3% noise",), ("78% of wafers",), ("Chance: 4%, 101 % or 55%",), ("What is the weather?",), (None,)], "t string")
    got = t.select(answers.out_of_scope(F.col("t"), ["weather", "stock"]).alias("o"), answers.probability_claims(F.col("t")).alias("p")).collect()
    assert [r.o for r in got] == [False, False, False, True, False]
    assert [list(r.p) for r in got] == [[78.0], [], [55.0], [], []]


def test_retrieval_quality(spark):
    docs = "array<struct<id: string, title: string, content: string>>"
    rows = [
        ("SOP-1 says: clean the chamber", [("SOP-1", "x", "clean chamber walls"), ("SOP-2", "Focus offset guide", "lens")], ["CHAMBER", "pump"]),
        ("see focus OFFSET guide", [("SOP-2", "Focus offset guide", "lens")], []), ("anything", [], ["a"]), (None, [("S", None, None)], None),
    ]
    t = spark.createDataFrame(rows, f"a string, d {docs}, e array<string>")
    got = t.select(*[c.alias(k) for k, c in answers.retrieval_quality(F.col("a"), F.col("d"), F.col("e")).items()]).collect()
    assert [tuple(round(x, 4) for x in r) for r in got] == [(0.5, 0.5, round(2 / 7, 4)), (1.0, 1.0, 0.75), (1.0, 1.0, 1.0), (0.0, 1.0, 0.5)]


def test_views_of_a_query(spark):
    t = spark.createDataFrame([("why", "a", "b"), ("why", "why", None), ("x", None, None), (None, None, None)], "q string, a string, b string")
    got = t.select(answers.sub_queries(F.col("q"), [F.col("a"), F.col("b")], 2).alias("v"), answers.overall_confidence(F.lit(1.0), F.lit(0.5)).alias("x")).collect()
    assert [list(r.v) for r in got] == [["why", "a"], ["why"], ["x"], []] and got[0].x == 0.8
