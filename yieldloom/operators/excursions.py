"""Single readings against the middle of their limits, and the leading excursions of each lot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from yieldloom.operators.lots import KEY


def excursion_scores(steps: DataFrame) -> DataFrame:
    """Per reading: z in sixths of the limit range from its middle, and the capability at that value.

    Readings without a value or limits have no score; limits without a range count one unit and capability 1.5.
    """
    t = steps.filter("value is not null and spec_min is not null and spec_max is not null")
    sigma = (F.col("spec_max") - F.col("spec_min")) / 6
    z = F.abs(F.col("value") - (F.col("spec_min") + F.col("spec_max")) / 2) / F.when(sigma > 0, sigma).otherwise(1.0)
    c = F.when(sigma > 0, F.least(F.col("spec_max") - F.col("value"), F.col("value") - F.col("spec_min")) / (3 * sigma)).otherwise(1.5)
    return t.select("lot_id", *KEY, "id", "value", z.alias("z"), c.alias("capability"))


def leading(scores: DataFrame, top: int = 3, bound: float = 6.0) -> DataFrame:
    """The top readings of each lot by z, with the softmax of their bounded z and a capped score.

    z counts to nine places, so that the order of operations decides no tie.
    """
    w = W.partitionBy("lot_id").orderBy(F.desc(F.round("z", 9)), *KEY, "id")
    t = scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    e = F.exp(F.least("z", F.lit(bound)))
    return t.withColumn("probability", e / F.sum(e).over(W.partitionBy("lot_id"))).withColumn("score", F.least(F.lit(0.95), 0.35 + 0.15 * F.col("z")))
