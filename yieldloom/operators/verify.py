"""Quantitative claims in texts, checked against reference values of their lot.

A numeric claim is grounded when a reference lies within its tolerance; references are an array per lot, so no
pairs of claims and references are made. Without references of its kind a claim can't be disproved and counts as
grounded. Texts without claims have a grounding rate of 1.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from yieldloom.functions.columns import between
from yieldloom.functions.text import claim_patterns

#: Control limits that a sigma claim may always name.
USUAL_SIGMAS = [1.5, 2.0, 3.0, 6.0]
#: Width of the cells of score_references; must be less than the least tolerance of a score, 0.05.
SCORE_CELL = 0.02


def claims(texts: DataFrame) -> DataFrame:
    """texts: id, lot_id, text. One row per claim: id, lot_id, kind, place (order within its kind), word, value."""
    found = F.concat(*[_found(kind, pattern) for kind, pattern in claim_patterns().items()])
    t = texts.filter("text is not null").select("id", "lot_id", F.explode(found).alias("c")).select("id", "lot_id", "c.kind", "c.place", "c.word")
    t = t.withColumn("value", F.when(F.col("kind") != "tool", F.col("word").cast("double")))
    return t.filter("kind <> 'risk_score' or value <= 1")


def _found(kind: str, pattern: str) -> Column:
    name = F.lit(kind).alias("kind")
    return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda w, i: F.struct(name, i.alias("place"), F.upper(w).alias("word")))


def tolerance() -> Column:
    return F.when(F.col("kind") == "sigma", 0.5).when(F.col("kind") == "cpk", F.greatest(F.lit(0.10), 0.05 * F.col("value"))).otherwise(F.greatest(F.lit(0.05), 0.05 * F.col("value")))


def score_references(findings: DataFrame) -> DataFrame:
    """findings: lot_id, risk_score, probability. lot_id and scores: the numbers from 0 to 1 among both, as references.

    Of each cell, narrower than the tolerance, only the least and the greatest value are kept. A claim is near one of
    the lot's values exactly when it is near one of those kept, which are some hundred a lot, however many findings it has.
    """
    t = findings.select("lot_id", F.explode(F.array("risk_score", "probability")).alias("v")).filter(between("v", 0, 1))
    t = t.groupBy("lot_id", F.floor(F.col("v") / SCORE_CELL).alias("cell")).agg(F.array(F.min("v"), F.max("v")).alias("v"))
    return t.groupBy("lot_id").agg(F.array_distinct(F.flatten(F.collect_list("v"))).alias("scores"))


def check(found: DataFrame, references: DataFrame) -> DataFrame:
    """references: lot_id, sigmas, cpks, scores (arrays of doubles), tools (upper case). Adds grounded."""
    t = found.join(references, "lot_id", "left")
    refs = F.when(F.col("kind") == "sigma", F.concat(F.coalesce("sigmas", F.array().cast("array<double>")), F.array(*map(F.lit, USUAL_SIGMAS)))).when(F.col("kind") == "cpk", F.col("cpks")).otherwise(F.col("scores"))
    none = F.coalesce(F.size("_refs") == 0, F.lit(True))
    t = t.withColumn("_refs", refs).withColumn("_tol", tolerance())
    near = F.exists("_refs", lambda r: F.abs(F.col("value") - r) <= F.col("_tol"))
    tool = F.coalesce(F.size("tools") == 0, F.lit(True)) | F.coalesce(F.array_contains("tools", F.col("word")), F.lit(False))
    grounded = F.when(F.col("kind") == "tool", tool).otherwise(F.coalesce(none | F.coalesce(near, F.lit(False)), F.lit(True)))
    return t.withColumn("grounded", grounded).select(*found.columns, "grounded")


def grounding(texts: DataFrame, checked: DataFrame) -> DataFrame:
    """Per text: claims, grounded ones, rate (1 without claims), passed."""
    g = checked.groupBy("id").agg(F.count(F.lit(1)).alias("claims"), F.count_if("grounded").alias("grounded"))
    t = texts.select("id").join(g, "id", "left").fillna(0, ["claims", "grounded"])
    return t.withColumn("rate", F.when(F.col("claims") == 0, 1.0).otherwise(F.col("grounded") / F.col("claims"))).withColumn("passed", F.col("claims") == F.col("grounded"))


def mark(texts: DataFrame, checked: DataFrame) -> DataFrame:
    """texts with marked: the first bare occurrence of each ungrounded claim's word in [UNVERIFIED: ...].

    Replacing once per word isn't in Spark's functions, so batches of texts go through pandas.
    """
    bad = checked.filter("not grounded").groupBy("id").agg(F.array_sort(F.collect_set("word")).alias("bad"))

    @F.pandas_udf("string")
    def marked(text: pd.Series, words: pd.Series) -> pd.Series:
        def one(t, ws):
            for w in () if t is None or ws is None else ws:
                t = re.sub(rf"(?<!\[UNVERIFIED: )(?<![\w.]){re.escape(w)}(?![\w])(?!\s*\])", lambda m: f"[UNVERIFIED: {m[0]}]", t, count=1, flags=re.IGNORECASE)
            return t

        return pd.Series([one(t, ws) for t, ws in zip(text, words)])

    return texts.join(bad, "id", "left").withColumn("marked", marked("text", "bad")).drop("bad")
