"""Totals over trailing periods from segment trees, one tree per entity and shard of days.

A tree is a table of nodes (entity, shard, level, node): level 0 has the days, a node of level k spans
2**k days, and a shard of 2**top days has one root. A node holds counts and sums, so a tree is built
by adding up, a range of days is a handful of nodes, and a late record changes one node per level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: A shard has 2**TOP days, so trees of a long history spread over many tasks.
TOP = 6


def day_number(ts: str | Column) -> Column:
    return F.unix_date(F.to_date(ts))


def daily(df: DataFrame, entity: Column, ts: Column, value: Column, valid: Column) -> DataFrame:
    """Records per (entity, day), valid values per day and their sum; records without entity or time are left out."""
    return (
        df.select(entity.alias("entity"), day_number(ts).alias("day"), F.when(valid, value).alias("v"))
        .filter(F.col("entity").isNotNull() & F.col("day").isNotNull())
        .groupBy("entity", "day")
        .agg(F.count(F.lit(1)).alias("records"), F.count("v").alias("values"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"))
    )


def build_trees(days: DataFrame, top: int = TOP) -> DataFrame:
    """All nodes above the given days: each day adds to one node per level."""
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("day", k).alias("node")) for k in range(top + 1)]))
    return (
        days.select("entity", F.shiftright("day", top).alias("shard"), levels.alias("at"), "records", "values", "total")
        .groupBy("entity", "shard", F.col("at.level").alias("level"), F.col("at.node").alias("node"))
        .agg(F.sum("records").alias("records"), F.sum("values").alias("values"), F.sum("total").alias("total"))
    )


def corrected_nodes(trees: DataFrame, late: DataFrame, top: int = TOP) -> DataFrame:
    """The nodes that late days (rows as of daily(); negative numbers take back) change, with their new content.

    Only ancestors of those days appear; every other node of the trees stays as it is.
    """
    keys = ["entity", "shard", "level", "node"]
    delta = build_trees(late, top)
    old = trees.select(*keys, *[F.col(c).alias(f"old_{c}") for c in ("records", "values", "total")])
    return delta.join(old, keys, "left").select(
        *keys, *[(F.col(c) + F.coalesce(f"old_{c}", F.lit(0))).alias(c) for c in ("records", "values", "total")]
    )


def apply_corrections(trees: DataFrame, late: DataFrame, top: int = TOP) -> DataFrame:
    """The trees with the changed nodes in the place of the old ones."""
    changed = corrected_nodes(trees, late, top)
    keys = ["entity", "shard", "level", "node"]
    return trees.join(changed, keys, "left_anti").unionByName(changed)


def range_nodes(first: Column, last: Column, top: int = TOP) -> Column:
    """The nodes (level, node) that together span the days first..last exactly.

    At level k, with l = ceil(first / 2**k) and r = floor((last + 1) / 2**k): while l < r, an odd l and an
    odd r each leave one node that no wider node covers; at the top level, all nodes between are taken.
    """
    end, parts = last + 1, []
    for k in range(top + 1):
        low, high = F.shiftright(first + (2**k - 1), k), F.shiftright(end, k)
        if k < top:
            odd = lambda c: F.pmod(c, F.lit(2)) == 1
            nodes = F.array_compact(F.array(F.when((low < high) & odd(low), low), F.when((low < high) & odd(high), high - 1)))
        else:
            nodes = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))
        level = F.lit(k).alias("level")
        parts.append(F.transform(nodes, lambda n: F.struct(level, n.cast("int").alias("node"))))
    return F.concat(*parts)


def trailing(trees: DataFrame, dates: DataFrame, periods: Sequence[int], top: int = TOP) -> DataFrame:
    """For each (entity, day) of dates and each period p: records_p, values_p, total_p of the p days that end there.

    Days without a record count as zeros; a period may begin before the first record.
    """
    asked = dates.select(
        "entity", "day",
        F.explode(F.array(*[F.struct(F.lit(p).alias("period"), range_nodes(F.col("day") - (p - 1), F.col("day"), top).alias("nodes")) for p in periods])).alias("q"),
    ).select("entity", "day", F.col("q.period").alias("period"), F.explode("q.nodes").alias("at"))
    found = asked.select("entity", "day", "period", F.col("at.level").alias("level"), F.col("at.node").alias("node")).join(
        trees.drop("shard"), ["entity", "level", "node"], "left"
    )
    return found.groupBy("entity", "day").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("period") == p, F.col(c))), F.lit(0)).alias(f"{c}_{p}")
            for p in periods for c in ("records", "values", "total")
        ]
    )


def day_grid(days: DataFrame) -> DataFrame:
    """Every day of an entity from its first to its last."""
    ends = days.groupBy("entity").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return ends.select("entity", F.explode(F.sequence("a", "b")).alias("day"))


def rolling_totals(df: DataFrame, entity: Column, ts: Column, value: Column, valid: Column, periods: Sequence[int] = (7, 30), top: int = TOP) -> DataFrame:
    """Per entity and day, days without records included: records, sum and mean over each trailing period.

    Columns: entity, day (date), and per period p records_p, values_p, total_p, mean_p (null without a value).
    Values that are not valid count as records only. Equal records all count. An empty table gives no rows.
    """
    days = daily(df, entity, ts, value, valid)
    t = trailing(build_trees(days, top), day_grid(days), periods, top)
    return t.select(
        "entity", F.date_from_unix_date("day").alias("day"),
        *[c for p in periods for c in (f"records_{p}", f"values_{p}", f"total_{p}")],
        *[F.when(F.col(f"values_{p}") > 0, F.col(f"total_{p}") / F.col(f"values_{p}")).alias(f"mean_{p}") for p in periods],
    )
