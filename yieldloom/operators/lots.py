"""Relational operators over lots, readings, defects and labels.

Every function takes and gives DataFrames as of sources.fab and works on all lots at once; a single lot is a
filter on its result, which Catalyst pushes down. Sorts end with the key, so their order is total.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

KEY = ["step", "tool_id", "parameter"]
#: Most rows of a table of sources or lots that is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def small(written: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if it has few rows, which are counted from the files' footers."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def where_equal(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows that equal every given value; None and "" mean no condition."""
    conditions = [F.col(c) == v for c, v in wanted.items() if v not in (None, "")]
    return df.filter(reduce(Column.__and__, conditions)) if conditions else df


def lot(lots: DataFrame, lot_id: str) -> DataFrame:
    return where_equal(lots, lot_id=lot_id).limit(1)


def readings(steps: DataFrame, lot_id: str | None = None, step: str | None = None, tool_id: str | None = None, parameter: str | None = None) -> DataFrame:
    """Readings with up to four equality conditions, in order of time."""
    return where_equal(steps, lot_id=lot_id, step=step, tool_id=tool_id, parameter=parameter).orderBy("ts", "id")


def defect_counts(defects: DataFrame) -> DataFrame:
    """Per lot: defects, wafers, and defects by severity."""
    of = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return defects.groupBy("lot_id").agg(F.count(F.lit(1)).alias("defects"), F.countDistinct("wafer_id").alias("wafers"), of("critical"), of("major"), of("minor"))


def overview(lots: DataFrame, defects: DataFrame, labels: DataFrame, **wanted: object) -> DataFrame:
    """Every lot with its number of defects (0 without any) and its labelled signature, null without a label.

    Defects are counted before the join, so a lot with many defects is one row when lots are joined.
    """
    counts = defects.groupBy("lot_id").agg(F.count(F.lit(1)).alias("defects"))
    t = where_equal(lots, **wanted).join(counts, "lot_id", "left").join(labels.select("lot_id", "injected_signature"), "lot_id", "left")
    return t.select("lot_id", "product_id", "start_time", "fab_line", "yield_pct", "status", F.coalesce("defects", F.lit(0)).alias("defects"), "injected_signature")


def kpis(lots: DataFrame, by: list[str] | None = None, excursion: float = 90.0, default_yield: float = 95.0) -> DataFrame:
    """Lots, mean yield (default_yield without any), lots at risk, excursions, and the lot of the worst yield."""
    t = lots.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("lots"), F.coalesce(F.avg("yield_pct"), F.lit(default_yield)).alias("mean_yield"),
        F.count_if(F.col("status") == "at_risk").alias("at_risk"), F.count_if(F.col("yield_pct") < excursion).alias("excursions"),
        F.min(F.when(F.col("yield_pct").isNotNull(), F.struct("yield_pct", "lot_id"))).alias("worst"),
    )
    return t.withColumn("worst_lot", F.col("worst.lot_id")).drop("worst")


def defect_types(defects: DataFrame) -> DataFrame:
    """Per lot and type the number of defects and the type's rank, most frequent first, then by name."""
    t = defects.groupBy("lot_id", "defect_type").agg(F.count(F.lit(1)).alias("defects"))
    return t.withColumn("rank", F.row_number().over(W.partitionBy("lot_id").orderBy(F.desc("defects"), "defect_type")))


def out_of_spec() -> Column:
    """Beyond a limit; a null limit or value is never exceeded."""
    return F.coalesce(F.col("value") > F.col("spec_max"), F.lit(False)) | F.coalesce(F.col("value") < F.col("spec_min"), F.lit(False))


def excursions(steps: DataFrame) -> DataFrame:
    """Readings out of their limits, with the side."""
    return steps.filter(out_of_spec()).withColumn("side", F.when(F.col("value") > F.col("spec_max"), "high").otherwise("low"))


def latest(steps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The last reading (by time, then id) of each lot, step, tool and parameter: last write wins.

    max_by aggregates on the map side, where a window would move every row.
    """
    by = by or ["lot_id", *KEY]
    rest = [c for c in steps.columns if c not in by]
    t = steps.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("ts", "id")).alias("r"))
    return t.select(*by, *[F.col(f"r.{c}").alias(c) for c in rest])


def first_limits(steps: DataFrame) -> DataFrame:
    """The first seen limits of each step, tool and parameter."""
    t = steps.groupBy(*KEY).agg(F.min_by(F.struct("spec_min", "spec_max"), F.struct("ts", "id")).alias("r"))
    return t.select(*KEY, F.col("r.spec_min").alias("spec_min"), F.col("r.spec_max").alias("spec_max"))


def lot_tools(steps: DataFrame) -> DataFrame:
    return steps.filter("tool_id is not null").select("lot_id", "step", "tool_id").distinct()


def candidate_steps(steps: DataFrame, defects: DataFrame) -> DataFrame:
    """Per lot the steps its defects were detected at, or, without any, all its steps."""
    seen = defects.filter("step is not null").select("lot_id", "step").distinct()
    rest = steps.filter("step is not null").select("lot_id", "step").distinct().join(seen.select("lot_id").distinct(), "lot_id", "left_anti")
    return seen.unionByName(rest)


def watch_list(lots: DataFrame, labels: DataFrame, top: int = 10) -> DataFrame:
    """The top unfinished lots, those at risk first, then the latest; the feature is the short list."""
    t = lots.filter(F.col("status").isin("at_risk", "in_progress")).join(labels.select("lot_id", "injected_signature"), "lot_id", "left")
    order = [F.when(F.col("status") == "at_risk", 0).otherwise(1), F.desc("start_time"), "lot_id"]
    short = t.orderBy(*order).limit(top)
    place = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order))
    return short.select("lot_id", "status", F.coalesce("injected_signature", F.lit("unknown")).alias("signature"), place.alias("place"))


def search(df: DataFrame, columns: list[str], text: str | None) -> DataFrame:
    """Rows with the text in one of the columns, whatever the case; all rows for an empty text."""
    if not text:
        return df
    hits = [F.coalesce(F.lower(c).contains(text.lower()), F.lit(False)) for c in columns]
    return df.filter(reduce(Column.__or__, hits))


def sessions(events: DataFrame, session: str, ts: str, order: str, kind: str, message: str, sender: str) -> DataFrame:
    """Per session: events, last time, and the last message of one sender (latest order value)."""
    return events.groupBy(session).agg(
        F.count(F.lit(1)).alias("events"), F.max(ts).alias("last_active"),
        F.max_by(F.when(F.col(kind) == sender, F.col(message)), F.when(F.col(kind) == sender, F.col(order))).alias("last_message"),
    )
