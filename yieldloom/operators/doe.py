"""Factorial experiments that would confirm the leading cause of each lot.

Factors are the cause's parameter and the first seen others of the same tool, three at most. Levels come from
the first seen limits (a tenth of the range either way, within them), else from the history (two deviations),
else a tenth of the mean. Runs are all 2**k corners and three centres in a shuffled order, which is made from
a hash of lot, run and seed instead of a generator's state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CENTERS = 3


def sample_size(effect: Column, least: float = 0.3) -> Column:
    """Wafers per run by Lehr's rule, 16 / effect**2, between 4 and 25."""
    e = F.greatest(F.coalesce(effect, F.lit(0.4)), F.lit(least))
    return F.least(F.greatest(F.ceil(16 / (e * e)), F.lit(4)), F.lit(25)).cast("int")


def factor_levels(steps: DataFrame, by: tuple[str, ...] = ("tool_id", "parameter")) -> DataFrame:
    """Per tool and parameter (or another grain): nominal, low and high level, and when the parameter was first seen."""
    t = steps.filter("value is not null").groupBy(*by).agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
        F.min_by("spec_min", F.when(F.col("spec_min").isNotNull(), F.struct("ts", "id"))).alias("lo"),
        F.min_by("spec_max", F.when(F.col("spec_max").isNotNull(), F.struct("ts", "id"))).alias("hi"), F.min(F.struct("ts", "id")).alias("seen"),
    )
    limits = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    nominal = F.when(limits, (F.col("lo") + F.col("hi")) / 2).otherwise(F.col("mean"))
    size = F.when(limits, (F.col("hi") - F.col("lo")) * 0.10).when(F.col("sd") > 1e-6, 2 * F.col("sd")).otherwise(F.when(F.col("mean") == 0, 1.0).otherwise(F.abs("mean") * 0.10))
    low, high = F.when(limits, F.greatest(nominal - size, F.col("lo"))).otherwise(nominal - size), F.when(limits, F.least(nominal + size, F.col("hi"))).otherwise(nominal + size)
    return t.select(*by, "seen", nominal.alias("nominal"), F.least(low, nominal).alias("low"), F.greatest(high, nominal).alias("high"))


def level_cascade(wanted: DataFrame, steps: DataFrame) -> DataFrame:
    """wanted: step, tool_id, parameter. Each with its levels from the history of the step, tool and parameter, or, without any, from
    that of the tool and parameter, or of the parameter alone; null levels if the parameter has no history. from: which of the three."""
    out, at = wanted, []
    for i, by in enumerate((("step", "tool_id", "parameter"), ("tool_id", "parameter"), ("parameter",))):
        names = {c: f"{c}_{i}" for c in ("nominal", "low", "high")}
        out = out.join(factor_levels(steps, by).drop("seen").withColumnsRenamed(names), list(by), "left")
        at.append(F.when(F.col(f"nominal_{i}").isNotNull(), F.lit(["step", "tool", "parameter"][i])))
    levels = [F.coalesce(*[F.col(f"{c}_{i}") for i in range(3)]).alias(c) for c in ("nominal", "low", "high")]
    return out.select("step", "tool_id", "parameter", *levels, F.coalesce(*at).alias("from"))


def factors(causes: DataFrame, levels: DataFrame, most: int = 3) -> DataFrame:
    """causes: lot_id, tool_id, parameter, deviation_score, one row per lot. One row per lot and factor, numbered from 0."""
    c = causes.select("lot_id", "tool_id", F.col("parameter").alias("main"), "deviation_score")
    t = c.join(levels, "tool_id")
    w = W.partitionBy("lot_id").orderBy(F.when(F.col("parameter") == F.col("main"), 0).otherwise(1), "seen", "parameter")
    return t.withColumn("factor", F.row_number().over(w) - 1).filter(F.col("factor") < most)


def runs(fs: DataFrame, seed: int = 42) -> DataFrame:
    """One row per lot, run and factor: coded level, value, type of run, order of execution and wafers."""
    k = F.count(F.lit(1)).over(W.partitionBy("lot_id"))
    t = fs.withColumn("k", k).withColumn("corners", F.pow(F.lit(2), F.col("k")).cast("int"))
    t = t.withColumn("run", F.explode(F.sequence(F.lit(1), F.col("corners") + CENTERS)))
    bit = F.pmod(F.floor((F.col("run") - 1) / F.pow(F.lit(2), F.col("factor"))), F.lit(2))
    coded = F.when(F.col("run") > F.col("corners"), 0).when(bit == 1, 1).otherwise(-1)
    value = F.when(coded == 0, F.col("nominal")).when(coded == 1, F.col("high")).otherwise(F.col("low"))
    order = F.dense_rank().over(W.partitionBy("lot_id").orderBy(F.md5(F.concat_ws("|", "lot_id", "run", F.lit(seed))), "run"))
    return t.select(
        "lot_id", "tool_id", "run", order.alias("run_order"), F.when(F.col("run") > F.col("corners"), "center").otherwise("corner").alias("type"),
        "factor", "parameter", coded.alias("coded"), value.alias("value"), sample_size(F.col("deviation_score")).alias("wafers"),
    )
