"""What ranked causes are worth: recoverable yield, and how often they are right."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from yieldloom.operators.lots import KEY


def yield_gaps(lots: DataFrame, default: float = 12.0) -> DataFrame:
    """Per lot how far its yield lies below the mean of the normal lots, at least 0; default where either is unknown."""
    normal = lots.filter("cohort = 'normal'").agg(F.avg("yield_pct").alias("normal_yield"))  # one row
    gap = F.greatest(F.col("normal_yield") - F.col("yield_pct"), F.lit(0.0))
    return lots.join(F.broadcast(normal)).select("lot_id", F.when(F.col("yield_pct").isNull() | F.col("normal_yield").isNull(), default).otherwise(gap).alias("gap"))


def recovery(ranked: DataFrame, lots: DataFrame, causes: int = 3) -> DataFrame:
    """Per lot and leading cause the yield attributed to it and recoverable, with bounds of 30 % either way."""
    t = ranked.filter(F.col("rank") <= causes).join(yield_gaps(lots), "lot_id")
    zero_free = lambda c: F.when(F.col(c) != 0, F.col(c))
    confidence = F.coalesce(zero_free("confidence"), zero_free("probability"), zero_free("risk_score"), F.lit(0.75))
    share = F.least(F.greatest(F.col("deviation_score") * confidence, F.lit(0.10)), F.lit(0.80))
    t = t.withColumn("lost", F.col("gap") * share).withColumn("got", F.col("lost") * F.least(confidence + 0.10, F.lit(0.90)))
    return t.select("lot_id", "rank", *KEY, "gap", F.col("lost").alias("attributed"), F.col("got").alias("recoverable"), (F.col("got") * 0.70).alias("low"), (F.col("got") * 1.30).alias("high"))


def total_recovery(parts: DataFrame) -> DataFrame:
    """Per lot the sum over its causes, at most the gap."""
    return parts.groupBy("lot_id").agg(F.min("gap").alias("gap"), F.count(F.lit(1)).alias("causes"), F.least(F.sum("recoverable"), F.min("gap")).alias("recoverable"))


def hits(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """Per labelled lot the rank of its true cause (null if it isn't ranked) and the score of the first candidate."""
    truth = labels.select(
        "lot_id", F.lower(F.trim("injected_cause_step")).alias("t_step"), F.upper(F.trim("injected_cause_tool_id")).alias("t_tool"), F.col("injected_cause_parameter").alias("t_parameter")
    )
    t = truth.join(ranked, "lot_id", "left")
    match = (F.col("step") == F.col("t_step")) & (F.col("tool_id") == F.col("t_tool")) & (F.col("parameter") == F.col("t_parameter"))
    return t.groupBy("lot_id").agg(F.min(F.when(match, F.col("rank"))).alias("true_rank"), F.max(F.when(F.col("rank") == 1, F.col("risk_score"))).alias("score"))


def accuracy(found: DataFrame, gate: float = 0.70) -> DataFrame:
    """One row: labelled lots, shares of top-1 and top-3 hits, Brier score of the first candidate's score, gate passed."""
    hit = F.when(F.col("true_rank") == 1, 1.0).otherwise(0.0)
    t = found.agg(
        F.count(F.lit(1)).alias("lots"), F.avg(hit).alias("top1"), F.avg(F.when(F.col("true_rank") <= 3, 1.0).otherwise(0.0)).alias("top3"),
        F.avg(F.pow(F.coalesce("score", F.lit(0.0)) - hit, 2)).alias("brier"),
    )
    return t.withColumn("passed", F.coalesce(F.col("top1") >= gate, F.lit(False)))


def calibration(found: DataFrame, bins: int = 5) -> DataFrame:
    """Per bin of the first candidate's score: lots, mean score and share of hits."""
    b = F.least(F.floor(F.coalesce("score", F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    return found.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("lots"), F.avg(F.coalesce("score", F.lit(0.0))).alias("predicted"), F.avg(F.when(F.col("true_rank") == 1, 1.0).otherwise(0.0)).alias("observed"))
