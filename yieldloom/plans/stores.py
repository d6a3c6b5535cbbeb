"""Queries that write tables, change them and read them back, and their SQL.

They write to folders of their own in the shared folder, which session.clean() removes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from yieldloom.functions.columns import between
from yieldloom.plans.relational import _KPI, lot_kpis
from yieldloom.session import own_folder
from yieldloom.sources import fab, sinks
from yieldloom.sources.tables import table


def changed_lots(spark: SparkSession, d: str) -> DataFrame:
    """All lots as a first version of a set of tables, then as a second one with changes, read by way of the pointer.

    Lots with a label come again as reviewed (upsert), the yield of lots at risk is taken back (update), and lots that
    were in progress without a yield are deleted.
    """
    folder = own_folder(spark, "lots")
    lots = fab.lots(spark, d).select("lot_id", "product_id", "yield_pct", "status")
    sinks.write_version({"lots": lots, "labels": fab.labels(spark, d).select("lot_id")}, folder)
    old = sinks.current(spark, folder)
    first = table(spark, old, "lots")
    again = first.join(table(spark, old, "labels"), "lot_id", "left_semi").withColumn("status", F.lit("reviewed"))
    t = sinks.update(sinks.upsert(first, again, ["lot_id"]), F.col("status") == "at_risk", yield_pct=F.lit(None).cast("double"))
    t = sinks.delete(t, first.filter("status = 'in_progress' and yield_pct is null").select("lot_id"))
    sinks.write_version({"lots": t}, folder)
    return table(spark, sinks.current(spark, folder), "lots")


def appended_findings(spark: SparkSession, d: str) -> DataFrame:
    """All findings appended to a log with new ids, those with a probability from 0 to 1 first; per append its rows and ids."""
    log = own_folder(spark, "findings")
    t = table(spark, d, "mock_findings").select("finding_id", "lot_id", "probability", between("probability", 0, 1).alias("scored"))
    for scored in (True, False):
        sinks.append(t.filter(F.col("scored") == scored), log)
    rows = F.count(F.lit(1)).alias("rows")
    return spark.read.parquet(log).groupBy("scored").agg(rows, F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.countDistinct("id").alias("ids"), F.countDistinct("finding_id").alias("findings"))


def exported_kpis(spark: SparkSession, d: str) -> DataFrame:
    """The report per line as CSV and as JSON, both read back."""
    t, ddl = lot_kpis(spark, d), "fab_line string, lots long, mean_yield double, at_risk long, excursions long, worst_lot string"
    out = []
    for kind in ("csv", "json"):
        path = own_folder(spark, f"kpis-{kind}")
        sinks.export(t, path, kind)
        back = spark.read.schema(ddl).option("header", True)
        out.append((back.csv(path) if kind == "csv" else back.json(path)).withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1])


QUERIES = {f.__name__: f for f in (changed_lots, appended_findings, exported_kpis)}

ORACLE = {
    "changed_lots": fab.SQL + """
SELECT lot_id, product_id, CASE WHEN new = 'at_risk' THEN NULL ELSE yield_pct END AS yield_pct, new AS status
FROM (SELECT *, CASE WHEN lot_id IN (SELECT lot_id FROM cause_labels) THEN 'reviewed' ELSE status END AS new FROM lots)
WHERE NOT coalesce(status = 'in_progress' AND yield_pct IS NULL, false)""",
    "appended_findings": """
WITH g AS (SELECT coalesce(probability BETWEEN 0 AND 1, false) AS scored, count(*) AS rows FROM mock_findings GROUP BY ALL)
SELECT scored, rows, CAST(sum(rows) OVER o AS BIGINT) - rows + 1 AS first_id, CAST(sum(rows) OVER o AS BIGINT) AS last_id, rows AS ids, rows AS findings FROM g WINDOW o AS (ORDER BY scored DESC)""",
    "exported_kpis": fab.SQL + f"SELECT fab_line, {_KPI}, kind FROM lots, (SELECT unnest(['csv', 'json']) AS kind) GROUP BY fab_line, kind",
}
