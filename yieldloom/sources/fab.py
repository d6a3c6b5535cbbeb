"""The tables of the wafer line in the form the analytical operators read them.

Names of tools, lines and steps get one spelling; NaN and, for yields and coordinates, impossible values become
null. No row is left out. Rows sent twice stay two rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from yieldloom.functions.columns import between, canonical, number
from yieldloom.sources.tables import optional_table, table

#: The contract of the tables; CHECK rules are in operators.quality.
SCHEMAS = {
    "wafer_lots": "lot_id string, product_id string, start_time timestamp_ntz, fab_line string, final_yield_pct double, status string",
    "process_steps": "id long, lot_id string, step_name string, tool_id string, parameter_name string, value double, spec_min double, spec_max double, timestamp timestamp_ntz",
    "defects": "id long, lot_id string, wafer_id string, defect_type string, x double, y double, severity string, detected_at_step string",
    "cause_labels": "lot_id string, injected_cause_step string, injected_cause_tool_id string, injected_cause_parameter string, injected_signature string",
}
STEPS = ["litho", "etch", "cvd", "cmp", "implant"]


def lots_of(df: DataFrame, threshold: float = 90.0) -> DataFrame:
    """lot_id, product_id, start_time, fab_line, yield_pct (null unless in 0..100), status, cohort.

    cohort: affected below the threshold, normal from it on, null for unfinished lots and lots without a yield.
    """
    t = df.select(
        "lot_id", "product_id", "start_time", canonical("fab_line").alias("fab_line"),
        F.when(between("final_yield_pct", 0, 100), F.col("final_yield_pct")).alias("yield_pct"), "status",
    )
    known = (F.col("status") != "in_progress") & F.col("yield_pct").isNotNull()
    return t.withColumn("cohort", F.when(known & (F.col("yield_pct") < threshold), "affected").when(known, "normal"))


def steps_of(df: DataFrame) -> DataFrame:
    """id, lot_id, step, tool_id, parameter, value (null if NaN), spec_min, spec_max, ts."""
    return df.select(
        "id", "lot_id", F.lower(F.trim("step_name")).alias("step"), canonical("tool_id").alias("tool_id"), F.col("parameter_name").alias("parameter"),
        number("value").alias("value"), number("spec_min").alias("spec_min"), number("spec_max").alias("spec_max"), F.col("timestamp").alias("ts"),
    )


def defects_of(df: DataFrame) -> DataFrame:
    """id, lot_id, wafer_id, defect_type, severity, step, x, y; a defect without a place on the wafer has neither x nor y."""
    place = between("x", -1, 1) & between("y", -1, 1)
    return df.select(
        "id", "lot_id", "wafer_id", "defect_type", "severity", F.lower(F.trim("detected_at_step")).alias("step"), *[F.when(place, F.col(c)).alias(c) for c in ("x", "y")]
    )


def lots(spark: SparkSession, d: str) -> DataFrame:
    return lots_of(table(spark, d, "wafer_lots"))


def steps(spark: SparkSession, d: str) -> DataFrame:
    return steps_of(table(spark, d, "process_steps"))


def defects(spark: SparkSession, d: str) -> DataFrame:
    return defects_of(table(spark, d, "defects"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels, or a typed table without rows where there are none."""
    return optional_table(spark, f"{d}/cause_labels.parquet", SCHEMAS["cause_labels"])


#: The same as SQL, for the oracle; each query adds its own steps.
SQL = """
WITH lots AS (
  SELECT *, CASE WHEN status <> 'in_progress' AND yield_pct < 90 THEN 'affected' WHEN status <> 'in_progress' AND yield_pct >= 90 THEN 'normal' END AS cohort FROM (
    SELECT lot_id, product_id, start_time, upper(trim(fab_line)) AS fab_line,
           CASE WHEN NOT isnan(final_yield_pct) AND final_yield_pct BETWEEN 0 AND 100 THEN final_yield_pct END AS yield_pct, status FROM wafer_lots)),
steps AS (
  SELECT id, lot_id, lower(trim(step_name)) AS step, upper(trim(tool_id)) AS tool_id, parameter_name AS parameter,
         CASE WHEN NOT isnan(value) THEN value END AS value, spec_min, spec_max, "timestamp" AS ts FROM process_steps),
marks AS (SELECT id, lot_id, wafer_id, defect_type, severity, lower(trim(detected_at_step)) AS step, x, y FROM defects),
places AS (SELECT * FROM marks WHERE x BETWEEN -1 AND 1 AND y BETWEEN -1 AND 1)
"""
