"""Synthetic wafers and telemetry from ranges, for tests and for scaling up; as many rows as asked, in parallel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHAPES = ["edge-ring", "center-cluster", "scratch", "donut", "random"]

STEPS = ["litho", "etch", "cvd", "cmp", "implant"]
#: Step, tools, and parameters with nominal value, deviation and limits, drawn from a rule: three tools and three parameters a step.
LINE = {
    step: ([f"{step.upper()}-{j + 1:02d}" for j in range(3)], [(f"{step}_{k}", 10.0 * (i + k + 1), 0.1 * (k + 1), 10.0 * (i + k + 1) - 0.4 * (k + 1), 10.0 * (i + k + 1) + 0.4 * (k + 1)) for k in range(3)])
    for i, step in enumerate(STEPS)
}


def _unit(*by: str | Column, salt: int) -> Column:
    """A number in [0, 1) made from columns, so that all rows of a wafer or lot share it."""
    return F.pmod(F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in by], F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def defects(wafers: DataFrame, points: int, seed: int = 0) -> DataFrame:
    """wafers: lot_id, wafer_id, shape. points defects a wafer in the form of the defects table."""
    t = wafers.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(points))))
    u = F.rand(seed)
    ring = lambda lo, hi: F.lit(lo) + (hi - lo) * F.rand(seed + 1)
    r = F.when(F.col("shape") == "edge-ring", ring(0.76, 0.97)).when(F.col("shape") == "donut", ring(0.42, 0.70)).when(F.col("shape") == "center-cluster", F.least(F.abs(F.randn(seed + 2)) * 0.14, F.lit(0.33)))
    r = r.otherwise(F.sqrt(F.rand(seed + 3)) * 0.97)
    a = u * 2 * math.pi
    along, slope = F.rand(seed + 4) * 1.4 - 0.7, _unit("lot_id", "wafer_id", salt=seed) * math.pi
    line = F.col("shape") == "scratch"
    x = F.when(line, along * F.cos(slope) + F.randn(seed + 5) * 0.012).otherwise(r * F.cos(a))
    y = F.when(line, along * F.sin(slope) + F.randn(seed + 6) * 0.012).otherwise(r * F.sin(a))
    t = t.select("lot_id", "wafer_id", x.alias("x"), y.alias("y"), F.rand(seed + 7).alias("p"), F.rand(seed + 8).alias("q"))
    kind = F.when(F.col("p") < 0.6, "particle").when(F.col("p") < 0.75, "scratch").when(F.col("p") < 0.9, "bridging").otherwise("void")
    severity = F.when(F.col("q") < 0.15, "critical").when(F.col("q") < 0.5, "major").otherwise("minor")
    return t.select(F.monotonically_increasing_id().alias("id"), "lot_id", "wafer_id", kind.alias("defect_type"), "x", "y", severity.alias("severity"), F.lit("etch").alias("detected_at_step"))


def lots(spark: SparkSession, n: int, drifted_every: int = 4, running_every: int = 10, seed: int = 0) -> DataFrame:
    """n lots in the form of wafer_lots, with drifted (boolean)."""
    t = spark.range(n).withColumn("lot_id", F.format_string("LOT-%07d", F.col("id") + 1)).withColumn("drifted", F.pmod("id", F.lit(drifted_every)) == 0)
    running = F.pmod("id", F.lit(running_every)) == running_every - 1
    y = F.when(running, F.lit(None)).when(F.col("drifted"), 72 + 11 * F.rand(seed)).otherwise(94 + 4.5 * F.rand(seed + 1))
    start = F.timestamp_seconds(1_767_225_600 + F.col("id") * 3600).cast("timestamp_ntz")
    status = F.when(running, "in_progress").otherwise("completed")
    return t.select("lot_id", F.lit("PROD-A").alias("product_id"), start.alias("start_time"), F.lit("LINE-01").alias("fab_line"), y.cast("double").alias("final_yield_pct"), status.alias("status"), "drifted")


def telemetry(lots_: DataFrame, tool: str = "ETCH-02", parameter: str = "etch_1", shift: float = 5.0, seed: int = 0) -> DataFrame:
    """One reading per lot, step and parameter in the form of process_steps; drifted lots run on the tool, shifted by so many deviations."""
    names = ["k", "step_name", "tools", "parameter_name", "nominal", "sd", "spec_min", "spec_max"]
    spec = [(i, s, tools, *p) for i, (s, (tools, ps)) in enumerate(LINE.items()) for p in ps]
    column = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    readings = F.explode(F.array(*[F.struct(*[column(v).alias(n) for n, v in zip(names, row)]) for row in spec]))
    t = lots_.withColumn("r", readings).select("*", "r.*").drop("r")
    at_tool = F.col("drifted") & F.array_contains("tools", tool)
    chosen = F.when(at_tool, F.lit(tool)).otherwise(F.element_at("tools", (F.floor(_unit("lot_id", "step_name", salt=seed) * F.size("tools")) + 1).cast("int")))
    hit = at_tool & (F.col("parameter_name") == parameter)
    value = F.col("nominal") + F.col("sd") * (F.randn(seed) + F.when(hit, shift).otherwise(0.0))
    ts = F.timestamp_seconds(F.unix_timestamp(F.col("start_time").cast("timestamp")) + 600 * F.col("k")).cast("timestamp_ntz")
    return t.select(F.monotonically_increasing_id().alias("id"), "lot_id", "step_name", chosen.alias("tool_id"), "parameter_name", value.alias("value"), "spec_min", "spec_max", ts.alias("timestamp"))
