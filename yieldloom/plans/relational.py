"""Queries over lots, readings, defects, labels and logs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from yieldloom.functions.columns import between, canonical, rounded
from yieldloom.operators import lots as ops, quality
from yieldloom.sources import fab
from yieldloom.sources.tables import table


def lot_overview(spark: SparkSession, d: str) -> DataFrame:
    t = ops.overview(fab.lots(spark, d), fab.defects(spark, d), fab.labels(spark, d))
    return t.orderBy("start_time", "lot_id")


def lot_kpis(spark: SparkSession, d: str) -> DataFrame:
    t = ops.kpis(fab.lots(spark, d), ["fab_line"])
    return t.withColumn("mean_yield", rounded("mean_yield", 4))


def fleet_kpis(spark: SparkSession, d: str) -> DataFrame:
    t = ops.kpis(fab.lots(spark, d))
    risky = table(spark, d, "mock_findings").agg(F.count_if((between("probability", 0.7, 1)) | between("risk_score", 0.7, 1)).alias("high_risk_findings"))
    return t.join(F.broadcast(risky)).withColumn("mean_yield", rounded("mean_yield", 4))  # one row each


def lots_of_line(spark: SparkSession, d: str) -> DataFrame:
    """Completed lots with a yield of every line that has a lot at risk."""
    lots = fab.lots(spark, d)
    wanted = ops.where_equal(lots, status="at_risk", product_id="").select("fab_line").distinct()
    t = ops.where_equal(lots, status="completed").join(wanted, "fab_line", "left_semi")
    return t.filter("yield_pct is not null").select("lot_id", "product_id", "start_time", "yield_pct")


def tool_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings of every tool and parameter that a label names, in order of time."""
    wanted = fab.labels(spark, d).select(canonical("injected_cause_tool_id").alias("tool_id"), F.col("injected_cause_parameter").alias("parameter")).distinct()
    return ops.readings(fab.steps(spark, d).join(wanted, ["tool_id", "parameter"], "left_semi")).select("id", "lot_id", "ts", "value")


def defect_page(spark: SparkSession, d: str) -> DataFrame:
    """The first 2,500 defects by id; the page's length is the feature."""
    return fab.defects(spark, d).orderBy("id").limit(2500).select("id", "lot_id", "wafer_id", "defect_type", "severity", "step")


def recent_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The 20 users who were active last; the list's length is the feature."""
    return user_sessions(spark, d).orderBy(F.desc("last_active"), "user_id").limit(20)


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """JSON out of a column and back into one: per kind of event, how many have a number k, their sum and the longest text written.

    Texts that are no JSON, or have no such field, count as having none.
    """
    t = table(spark, d, "events").withColumn("p", F.from_json("props", "k long"))
    back = F.coalesce(F.to_json("p"), F.lit("{}"))
    return t.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count("p.k").alias("with_k"), F.sum("p.k").alias("sum_k"), F.max(F.length(back)).alias("longest"))


def defect_severity(spark: SparkSession, d: str) -> DataFrame:
    return ops.defect_counts(fab.defects(spark, d))


def defect_types(spark: SparkSession, d: str) -> DataFrame:
    return ops.defect_types(fab.defects(spark, d))


def spec_excursions(spark: SparkSession, d: str) -> DataFrame:
    return ops.excursions(fab.steps(spark, d)).select("id", "lot_id", "step", "tool_id", "parameter", "value", "side")


def lot_steps_out_of_spec(spark: SparkSession, d: str) -> DataFrame:
    return fab.steps(spark, d).groupBy("lot_id", "step").agg(F.count(F.lit(1)).alias("readings"), F.count_if(ops.out_of_spec()).alias("out_of_spec"))


def latest_readings(spark: SparkSession, d: str) -> DataFrame:
    return ops.latest(fab.steps(spark, d)).select("lot_id", *ops.KEY, "id", "value")


def first_limits(spark: SparkSession, d: str) -> DataFrame:
    return ops.first_limits(fab.steps(spark, d))


def lot_tools(spark: SparkSession, d: str) -> DataFrame:
    return ops.lot_tools(fab.steps(spark, d))


def candidate_steps(spark: SparkSession, d: str) -> DataFrame:
    return ops.candidate_steps(fab.steps(spark, d), fab.defects(spark, d))


def watch_list(spark: SparkSession, d: str) -> DataFrame:
    return ops.watch_list(fab.lots(spark, d), fab.labels(spark, d))


def labelled_lots(spark: SparkSession, d: str) -> DataFrame:
    return fab.labels(spark, d).join(fab.lots(spark, d), "lot_id").select("lot_id", "status", "yield_pct", "injected_cause_step", "injected_signature")


def finding_search(spark: SparkSession, d: str) -> DataFrame:
    """Edge-ring findings that name an etch tool or parameter, whatever the case."""
    t = ops.search(table(spark, d, "mock_findings"), ["lot_id", "tool_id", "evidence"], "Etch")
    return ops.where_equal(t, spatial_signature="edge-ring").select("finding_id", "lot_id", "tool_id")


def finding_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Means and conditional counts of the findings by basis; impossible scores count as none."""
    p, r = F.when(between("probability", 0, 1), F.col("probability")), F.when(between("risk_score", 0, 1), F.col("risk_score"))
    t = table(spark, d, "mock_findings").groupBy("confidence_basis").agg(
        F.count(F.lit(1)).alias("findings"), F.round(F.avg(p), 6).alias("mean_probability"), F.round(F.avg(r), 6).alias("mean_risk"), F.round(F.avg("sample_size"), 6).alias("mean_samples"),
        F.count_if(F.coalesce(p, r) >= 0.7).alias("high"), F.count_if(F.coalesce(F.col("evidence") == "", F.lit(True))).alias("without_evidence"),
        F.round(F.avg(F.when(F.col("tool_id").isNull(), 1.0).otherwise(0.0)), 6).alias("no_tool_rate"),
    )
    return t


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ops.sessions(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type", "props", "click")


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.report(*[table(spark, d, t) for t in ("wafer_lots", "process_steps", "defects", "cause_labels")])


def cause_drift(spark: SparkSession, d: str) -> DataFrame:
    t = quality.drift(fab.steps(spark, d), fab.labels(spark, d))
    return t.select(*ops.KEY, "readings", *[F.round(c, 4).alias(c) for c in ("mean", "base_mean", "base_sd", "shift")])


QUERIES = {
    f.__name__: f for f in (
        lot_overview, lot_kpis, fleet_kpis, lots_of_line, tool_readings, defect_page, recent_sessions, event_properties, defect_severity, defect_types, spec_excursions, lot_steps_out_of_spec, latest_readings, first_limits,
        lot_tools, candidate_steps, watch_list, labelled_lots, finding_search, finding_metrics, user_sessions, quality_report, cause_drift,
    )
}

S = fab.SQL
_KPI = """count(*) AS lots, round(coalesce(avg(yield_pct), 95.0) + 1e-9, 4) AS mean_yield, count(*) FILTER (WHERE status = 'at_risk') AS at_risk,
       count(*) FILTER (WHERE yield_pct < 90) AS excursions, arg_min(lot_id, (yield_pct, lot_id)) FILTER (WHERE yield_pct IS NOT NULL) AS worst_lot"""
_NUM = "({0} IS NOT NULL AND NOT isnan({0}))"


def _rule(table_: str, name: str, ok: str) -> str:
    return f"SELECT '{name}' AS rule, count(*) AS checked, count(*) FILTER (WHERE NOT coalesce({ok}, false)) AS violations FROM {table_}"


_STEP_IN = "IN ('litho', 'etch', 'cvd', 'cmp', 'implant')"
_RULES = [
    ("wafer_lots", "lot status", "status IN ('completed', 'in_progress', 'at_risk')"),
    ("wafer_lots", "lot yield is a percentage", f"final_yield_pct IS NULL OR ({_NUM.format('final_yield_pct')} AND final_yield_pct BETWEEN 0 AND 100)"),
    ("wafer_lots", "yield missing only while in progress", "status <> 'completed' OR final_yield_pct IS NOT NULL"),
    ("wafer_lots", "no yield while in progress", "status <> 'in_progress' OR final_yield_pct IS NULL"),
    ("process_steps", "step name", f"step_name {_STEP_IN}"), ("process_steps", "reading is a number", _NUM.format("value")),
    ("process_steps", "limits in order", "spec_min < spec_max"), ("process_steps", "tool in its usual spelling", "tool_id = upper(trim(tool_id))"),
    ("defects", "defect has a wafer", "wafer_id IS NOT NULL"), ("defects", "defect coordinates", "x BETWEEN -1 AND 1 AND y BETWEEN -1 AND 1"),
    ("defects", "defect on the disk", f"{_NUM.format('x')} AND {_NUM.format('y')} AND x * x + y * y <= 1.0001"),
    ("defects", "defect severity", "severity IN ('critical', 'major', 'minor')"), ("defects", "defect step", f"detected_at_step {_STEP_IN}"),
]
_ORPHANS = [
    f"SELECT '{t}.lot_id has a lot', CAST(NULL AS BIGINT), count(*) FROM {t} c WHERE NOT EXISTS (SELECT 1 FROM wafer_lots l WHERE l.lot_id = c.lot_id)"
    for t in ("process_steps", "defects", "cause_labels")
]
_OUT = "(coalesce(value > spec_max, false) OR coalesce(value < spec_min, false))"
_SESSIONS = """
SELECT user_id, count(*) AS events, max(ts) AS last_active, arg_max(props, event_id) FILTER (WHERE event_type = 'click') AS last_message FROM events GROUP BY user_id
"""

ORACLE = {
    "lot_overview": S + """
SELECT l.lot_id, product_id, start_time, fab_line, yield_pct, status, coalesce(n, 0) AS defects, c.injected_signature FROM lots l
LEFT JOIN (SELECT lot_id, count(*) AS n FROM marks GROUP BY lot_id) p USING (lot_id) LEFT JOIN cause_labels c USING (lot_id)""",
    "lot_kpis": S + f"SELECT fab_line, {_KPI} FROM lots GROUP BY fab_line",
    "fleet_kpis": S + f"""
SELECT {_KPI}, (SELECT count(*) FROM mock_findings WHERE probability BETWEEN 0.7 AND 1 OR risk_score BETWEEN 0.7 AND 1) AS high_risk_findings FROM lots""",
    "lots_of_line": S + "SELECT lot_id, product_id, start_time, yield_pct FROM lots WHERE fab_line IN (SELECT fab_line FROM lots WHERE status = 'at_risk') AND status = 'completed' AND yield_pct IS NOT NULL",
    "tool_readings": S + "SELECT id, lot_id, ts, value FROM steps WHERE (tool_id, parameter) IN (SELECT upper(trim(injected_cause_tool_id)), injected_cause_parameter FROM cause_labels)",
    "defect_page": S + "SELECT id, lot_id, wafer_id, defect_type, severity, step FROM marks ORDER BY id LIMIT 2500",
    "recent_sessions": _SESSIONS + "ORDER BY last_active DESC, user_id LIMIT 20",
    "event_properties": """
SELECT event_type, count(*) AS events, count(k) AS with_k, CAST(sum(k) AS BIGINT) AS sum_k, max(CASE WHEN k IS NULL THEN 2 ELSE 6 + length(CAST(k AS VARCHAR)) END) AS longest
FROM (SELECT event_type, CASE WHEN json_valid(props) THEN TRY_CAST(props->>'$.k' AS BIGINT) END AS k FROM events) GROUP BY event_type""",
    "defect_severity": S + """
SELECT lot_id, count(*) AS defects, count(DISTINCT wafer_id) AS wafers, count(*) FILTER (WHERE severity = 'critical') AS critical,
       count(*) FILTER (WHERE severity = 'major') AS major, count(*) FILTER (WHERE severity = 'minor') AS minor FROM marks GROUP BY lot_id""",
    "defect_types": S + """
SELECT lot_id, defect_type, defects, CAST(row_number() OVER (PARTITION BY lot_id ORDER BY defects DESC, defect_type) AS INTEGER) AS rank
FROM (SELECT lot_id, defect_type, count(*) AS defects FROM marks GROUP BY ALL)""",
    "spec_excursions": S + f"SELECT id, lot_id, step, tool_id, parameter, value, CASE WHEN value > spec_max THEN 'high' ELSE 'low' END AS side FROM steps WHERE {_OUT}",
    "lot_steps_out_of_spec": S + f"SELECT lot_id, step, count(*) AS readings, count(*) FILTER (WHERE {_OUT}) AS out_of_spec FROM steps GROUP BY lot_id, step",
    "latest_readings": S + """
SELECT lot_id, step, tool_id, parameter, id, value FROM steps
QUALIFY row_number() OVER (PARTITION BY lot_id, step, tool_id, parameter ORDER BY ts DESC, id DESC) = 1""",
    "first_limits": S + """
SELECT step, tool_id, parameter, spec_min, spec_max FROM steps
QUALIFY row_number() OVER (PARTITION BY step, tool_id, parameter ORDER BY ts, id) = 1""",
    "lot_tools": S + "SELECT DISTINCT lot_id, step, tool_id FROM steps WHERE tool_id IS NOT NULL",
    "candidate_steps": S + """, seen AS (SELECT DISTINCT lot_id, step FROM marks WHERE step IS NOT NULL)
SELECT * FROM seen UNION ALL SELECT DISTINCT lot_id, step FROM steps WHERE step IS NOT NULL AND lot_id NOT IN (SELECT lot_id FROM seen WHERE lot_id IS NOT NULL)""",
    "watch_list": S + """
SELECT lot_id, status, coalesce(injected_signature, 'unknown') AS signature, CAST(row_number() OVER o AS INTEGER) AS place FROM lots LEFT JOIN cause_labels USING (lot_id)
WHERE status IN ('at_risk', 'in_progress') WINDOW o AS (ORDER BY CASE WHEN status = 'at_risk' THEN 0 ELSE 1 END, start_time DESC, lot_id) ORDER BY place LIMIT 10""",
    "labelled_lots": S + "SELECT lot_id, status, yield_pct, injected_cause_step, injected_signature FROM cause_labels JOIN lots USING (lot_id)",
    "finding_search": """
SELECT finding_id, lot_id, tool_id FROM mock_findings WHERE spatial_signature = 'edge-ring'
  AND (contains(lower(lot_id), 'etch') OR contains(lower(tool_id), 'etch') OR contains(lower(evidence), 'etch'))""",
    "finding_metrics": """
SELECT confidence_basis, count(*) AS findings, round(avg(p), 6) AS mean_probability, round(avg(r), 6) AS mean_risk, round(avg(sample_size), 6) AS mean_samples,
       count(*) FILTER (WHERE coalesce(p, r) >= 0.7) AS high, count(*) FILTER (WHERE evidence IS NULL OR evidence = '') AS without_evidence,
       round(avg(CASE WHEN tool_id IS NULL THEN 1.0 ELSE 0.0 END), 6) AS no_tool_rate
FROM (SELECT *, CASE WHEN probability BETWEEN 0 AND 1 THEN probability END AS p, CASE WHEN risk_score BETWEEN 0 AND 1 THEN risk_score END AS r FROM mock_findings) GROUP BY confidence_basis""",
    "user_sessions": _SESSIONS,
    "quality_report": " UNION ALL ".join([_rule(*r) for r in _RULES] + _ORPHANS),
    "cause_drift": S + """, injected AS (
  SELECT lower(trim(injected_cause_step)) AS step, upper(trim(injected_cause_tool_id)) AS tool_id, injected_cause_parameter AS parameter, lot_id FROM cause_labels),
marked AS (
  SELECT s.*, EXISTS (SELECT 1 FROM injected i WHERE i.step = s.step AND i.tool_id = s.tool_id AND i.parameter = s.parameter AND i.lot_id = s.lot_id) AS hit FROM steps s
  WHERE value IS NOT NULL AND EXISTS (SELECT 1 FROM injected i WHERE i.step = s.step AND i.tool_id = s.tool_id AND i.parameter = s.parameter)),
g AS (SELECT step, tool_id, parameter, count(*) FILTER (WHERE hit) AS readings, avg(value) FILTER (WHERE hit) AS mean, avg(value) FILTER (WHERE NOT hit) AS base_mean,
             stddev_samp(value) FILTER (WHERE NOT hit) AS base_sd FROM marked GROUP BY ALL)
SELECT step, tool_id, parameter, readings, round(mean, 4) AS mean, round(base_mean, 4) AS base_mean, round(base_sd, 4) AS base_sd,
       round(CASE WHEN base_sd > 1e-12 THEN (mean - base_mean) / base_sd END, 4) AS shift FROM g""",
}
