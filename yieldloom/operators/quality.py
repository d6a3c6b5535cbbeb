"""Rules that the tables must keep: one row per rule with the number of rows checked and of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from yieldloom.sources.fab import STEPS


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose key is missing in the parent; a null key counts as missing."""
    return child.join(parent.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def _checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All rules of one table in one pass; a rule that is null for a row is violated."""
    one = df.agg(F.count(F.lit(1)).alias("checked"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(r) for r, ok in rules.items()])
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in rules])
    return one.select("checked", F.explode(pairs).alias("p")).select("p.rule", "checked", "p.violations")


def report(lots: DataFrame, steps: DataFrame, defects: DataFrame, labels: DataFrame) -> DataFrame:
    """rule, checked, violations over the raw tables."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    parts = [
        _checked(lots, {
            "lot status": F.col("status").isin("completed", "in_progress", "at_risk"),
            "lot yield is a percentage": F.col("final_yield_pct").isNull() | (number("final_yield_pct") & F.col("final_yield_pct").between(0, 100)),
            "yield missing only while in progress": (F.col("status") != "completed") | F.col("final_yield_pct").isNotNull(),
            "no yield while in progress": (F.col("status") != "in_progress") | F.col("final_yield_pct").isNull(),
        }),
        _checked(steps, {
            "step name": F.col("step_name").isin(*STEPS), "reading is a number": number("value"),
            "limits in order": F.col("spec_min") < F.col("spec_max"), "tool in its usual spelling": F.col("tool_id") == F.upper(F.trim("tool_id")),
        }),
        _checked(defects, {
            "defect has a wafer": F.col("wafer_id").isNotNull(), "defect coordinates": number("x") & number("y") & F.col("x").between(-1, 1) & F.col("y").between(-1, 1),
            "defect on the disk": number("x") & number("y") & (F.col("x") ** 2 + F.col("y") ** 2 <= 1.0001), "defect severity": F.col("severity").isin("critical", "major", "minor"),
            "defect step": F.col("detected_at_step").isin(*STEPS),
        }),
    ]
    for name, child in (("process_steps", steps), ("defects", defects), ("cause_labels", labels)):
        lost = orphans(child, lots, "lot_id").agg(F.count(F.lit(1)).alias("violations"))
        parts.append(lost.select(F.lit(f"{name}.lot_id has a lot").alias("rule"), F.lit(None).cast("long").alias("checked"), "violations"))
    return reduce(DataFrame.unionByName, parts)


def drift(steps: DataFrame, labels: DataFrame) -> DataFrame:
    """Per labelled cause: readings of its labelled lots against those of all others, in standard deviations of the others."""
    key = ["step", "tool_id", "parameter"]
    injected = labels.select(
        F.lower(F.trim("injected_cause_step")).alias("step"), F.upper(F.trim("injected_cause_tool_id")).alias("tool_id"), F.col("injected_cause_parameter").alias("parameter"), "lot_id"
    )
    marked = steps.filter("value is not null").join(injected.select(*key).distinct(), key, "left_semi").join(injected.withColumn("hit", F.lit(True)), [*key, "lot_id"], "left")
    hit = F.col("hit").isNotNull()
    t = marked.groupBy(*key).agg(
        F.count_if(hit).alias("readings"), F.avg(F.when(hit, F.col("value"))).alias("mean"), F.avg(F.when(~hit, F.col("value"))).alias("base_mean"),
        F.stddev_samp(F.when(~hit, F.col("value"))).alias("base_sd"),
    )
    return t.withColumn("shift", F.when(F.col("base_sd") > 1e-12, (F.col("mean") - F.col("base_mean")) / F.col("base_sd")))
