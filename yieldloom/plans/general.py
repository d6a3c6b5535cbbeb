"""Queries of the general data-preparation problems (p1, p5, p6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from yieldloom.functions.columns import between, canonical, rounded
from yieldloom.operators import eager, rolling, spikes
from yieldloom.session import materialize
from yieldloom.sources.tables import table


def _radius():
    return F.hypot("x", "y")


def _states(spark: SparkSession, d: str) -> DataFrame:
    """Joined compact states of process_steps by (lot, tool) and defects by lot, both sides kept whole."""
    steps = eager.compact(table(spark, d, "process_steps"), {"lot_id": canonical("lot_id"), "tool_id": canonical("tool_id")}, {"value": F.col("value")})
    defects = eager.compact(table(spark, d, "defects"), {"lot_id": canonical("lot_id")}, {"radius": _radius()})
    return materialize(eager.join_states(steps, defects, ["lot_id"], "full"), "states")  # read twice below


def p1_key_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows per defects.lot_id and per process_steps.tool_id, rolled up from the same joined states."""
    states = _states(spark, d)
    lots = states.groupBy("lot_id").agg(F.max("own_right").alias("rows")).filter("rows > 0")
    tools = eager.roll_up(states.filter("own_left > 0"), ["tool_id"], own="left")
    return lots.select(F.lit("defects.lot_id").alias("field"), F.col("lot_id").alias("key_value"), "rows").unionByName(
        tools.select(F.lit("process_steps.tool_id").alias("field"), F.col("tool_id").alias("key_value"), F.col("own_rows").alias("rows"))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return eager.heavy_keys(materialize(p1_key_rows(spark, d), "key_rows"), "field", "key_value", "rows", 0.04).select("field", "key_value")


def p1_tool_defects(spark: SparkSession, d: str) -> DataFrame:
    """Per tool, over process_steps joined with defects of the same lot: pairs, mean reading and mean defect radius."""
    t = eager.eager_join_aggregate(
        table(spark, d, "process_steps"), table(spark, d, "defects"), {"lot_id": (canonical("lot_id"), canonical("lot_id"))},
        by_left={"tool_id": canonical("tool_id")}, left_measures={"value": F.col("value")}, right_measures={"radius": _radius()},
    )
    return t.select(
        "tool_id", F.col("n").alias("pairs"), F.col("c_radius").alias("radii"),
        F.round(F.when(F.col("c_value") > 0, F.col("s_value") / F.col("c_value")), 4).alias("mean_value"),
        F.round(F.when(F.col("c_radius") > 0, F.col("s_radius") / F.col("c_radius")), 6).alias("mean_radius"),
    )


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("final_yield_pct")
    return rolling.rolling_totals(table(spark, d, "wafer_lots"), canonical("fab_line"), F.col("start_time"), y, between(y, 0, 100))


def p5_rolling(spark: SparkSession, d: str) -> DataFrame:
    t = _rolling(spark, d)
    return t.select(
        F.col("entity").alias("fab_line"), F.date_format("day", "yyyy-MM-dd").alias("day"),
        *[x for p in (7, 30) for x in (
            F.col(f"records_{p}").alias(f"lots_{p}"), F.round(f"total_{p}", 4).alias(f"yield_sum_{p}"), rounded(f"mean_{p}", 6).alias(f"yield_mean_{p}"))],
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """A difference within 1e-9 of 3.0 counts as 3.0, so the order of summing doesn't decide."""
    t = _rolling(spark, d).filter(F.col("mean_30") - F.col("mean_7") >= 3.0 - 1e-9)
    return t.select(F.col("entity").alias("fab_line"), F.date_format("day", "yyyy-MM-dd").alias("day"))


def p5_corrected(spark: SparkSession, d: str) -> DataFrame:
    """Late corrections: trees of the lots that started before the last week, in which the lots of that week change only ancestor nodes."""
    y = F.col("final_yield_pct")
    days = rolling.daily(table(spark, d, "wafer_lots"), canonical("fab_line"), F.col("start_time"), y, between(y, 0, 100))
    last = F.broadcast(days.agg((F.max("day") - 7).alias("cut")))  # one row
    marked = materialize(days.join(last).withColumn("late", F.col("day") > F.col("cut")).drop("cut"), "days")
    trees = rolling.apply_corrections(rolling.build_trees(marked.filter("not late").drop("late")), marked.filter("late").drop("late"))
    return trees.select("entity", "level", "node", "records", "values", F.round("total", 4).alias("total"))


def p6_flags(spark: SparkSession, d: str) -> DataFrame:
    t = spikes.flag_readings(table(spark, d, "process_steps"), "id", canonical("tool_id"), F.col("parameter_name"), "timestamp", "value")
    return t.select("id", F.col("tool").alias("tool_id"), F.col("param").alias("parameter_name"), "kind")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_flags(spark, d).select("id")


QUERIES = {
    "p1_found": p1_found, "p1_key_rows": p1_key_rows, "p1_tool_defects": p1_tool_defects,
    "p5_found": p5_found, "p5_rolling": p5_rolling, "p5_corrected": p5_corrected, "p6_found": p6_found, "p6_flags": p6_flags,
}

_KEY_ROWS = """
SELECT 'defects.lot_id' AS field, upper(trim(lot_id)) AS key_value, count(*) AS rows FROM defects GROUP BY upper(trim(lot_id))
UNION ALL
SELECT 'process_steps.tool_id', upper(trim(tool_id)), count(*) FROM process_steps GROUP BY upper(trim(tool_id))
"""

_DAYS = """
WITH lots AS (
  SELECT upper(trim(fab_line)) AS fab_line, CAST(start_time AS DATE) AS day,
         CASE WHEN NOT isnan(final_yield_pct) AND final_yield_pct BETWEEN 0 AND 100 THEN final_yield_pct END AS y
  FROM wafer_lots WHERE fab_line IS NOT NULL AND start_time IS NOT NULL),
ends AS (SELECT fab_line, min(day) AS a, max(day) AS b FROM lots GROUP BY fab_line),
grid AS (SELECT fab_line, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM ends),
r AS (
  SELECT g.fab_line, g.day,
         count(l.fab_line) AS n30, sum(l.y) AS s30, avg(l.y) AS m30,
         count(l.fab_line) FILTER (WHERE l.day > g.day - 7) AS n7, sum(l.y) FILTER (WHERE l.day > g.day - 7) AS s7,
         avg(l.y) FILTER (WHERE l.day > g.day - 7) AS m7
  FROM grid g LEFT JOIN lots l ON l.fab_line = g.fab_line AND l.day <= g.day AND l.day > g.day - 30
  GROUP BY g.fab_line, g.day)
"""

_FLAGS = """
WITH r AS (
  SELECT *, upper(trim(tool_id)) AS tool, min(id) OVER (PARTITION BY lot_id, step_name, tool_id, parameter_name, value, spec_min, spec_max, "timestamp") AS original
  FROM process_steps WHERE tool_id IS NOT NULL AND parameter_name IS NOT NULL AND "timestamp" IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
o AS (
  SELECT *, row_number() OVER s AS i, value - lag(value) OVER s AS d, count(*) OVER (PARTITION BY tool, parameter_name) AS n FROM r WHERE id = original
  WINDOW s AS (PARTITION BY tool, parameter_name ORDER BY "timestamp", id)),
runs AS (SELECT *, sum(CASE WHEN d = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY tool, parameter_name ORDER BY i) AS run FROM o),
ro AS (SELECT *, count(*) OVER (PARTITION BY tool, parameter_name, run) AS len FROM runs),
sc AS (SELECT tool, parameter_name, 1.4826 * median(abs(d)) / sqrt(2) AS s FROM ro WHERE len < 3 GROUP BY ALL),
m AS (
  SELECT ro.*, s, median(value) OVER (PARTITION BY tool, parameter_name ORDER BY i ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS before,
         median(value) OVER (PARTITION BY tool, parameter_name ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS after FROM ro JOIN sc USING (tool, parameter_name)),
c AS (
  SELECT original, CASE WHEN len >= 8 THEN 'stuck' WHEN abs(value) > 1e7 THEN 'impossible'
                        WHEN coalesce(abs(value - before) > 6.5 * s, true) AND coalesce(abs(value - after) > 6.5 * s, true) THEN 'spike' END AS kind FROM m WHERE n >= 20),
f AS (SELECT id, tool AS tool_id, parameter_name, kind FROM r JOIN c USING (original) WHERE kind IS NOT NULL)
"""


ORACLE = {
    "p1_key_rows": _KEY_ROWS,
    "p1_found": f"""
SELECT field, key_value FROM (SELECT *, sum(rows) OVER (PARTITION BY field) AS total FROM ({_KEY_ROWS}))
WHERE rows >= 0.04 * total AND key_value IS NOT NULL""",
    "p1_tool_defects": """
SELECT upper(trim(s.tool_id)) AS tool_id, count(*) AS pairs, count(CASE WHEN NOT isnan(d.r) THEN d.r END) AS radii,
       round(avg(CASE WHEN NOT isnan(s.value) THEN s.value END), 4) AS mean_value,
       round(avg(CASE WHEN NOT isnan(d.r) THEN d.r END), 6) AS mean_radius
FROM process_steps s JOIN (SELECT upper(trim(lot_id)) AS lot, sqrt(x * x + y * y) AS r FROM defects) d ON d.lot = upper(trim(s.lot_id))
GROUP BY upper(trim(s.tool_id))""",
    "p6_found": _FLAGS + "SELECT id FROM f",
    "p6_flags": _FLAGS + "SELECT * FROM f",
    "p5_rolling": _DAYS + """
SELECT fab_line, strftime(day, '%Y-%m-%d') AS day, n7 AS lots_7, round(coalesce(s7, 0), 4) AS yield_sum_7, round(m7 + 1e-9, 6) AS yield_mean_7,
       n30 AS lots_30, round(coalesce(s30, 0), 4) AS yield_sum_30, round(m30 + 1e-9, 6) AS yield_mean_30 FROM r""",
    "p5_corrected": """
SELECT entity, CAST(level AS INTEGER) AS level, node, count(*) AS records, count(y) AS "values", round(coalesce(sum(y), 0), 4) AS total FROM (
  SELECT upper(trim(fab_line)) AS entity, level, CAST(floor((CAST(start_time AS DATE) - DATE '1970-01-01') / pow(2, level)) AS INTEGER) AS node,
         CASE WHEN NOT isnan(final_yield_pct) AND final_yield_pct BETWEEN 0 AND 100 THEN final_yield_pct END AS y
  FROM wafer_lots, range(7) l(level) WHERE fab_line IS NOT NULL AND start_time IS NOT NULL) GROUP BY ALL""",
    "p5_found": _DAYS + "SELECT fab_line, strftime(day, '%Y-%m-%d') AS day FROM r WHERE m30 - m7 >= 3.0 - 1e-9",
}
