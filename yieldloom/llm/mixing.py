"""One mix of several sources with target shares of the total size, by systematic sampling.

Every item of a source is expected c times, c = total * share / size of the source, at most max_repeats.
Items are ordered by (size, id) within their source; the running sum of expected copies is c * rank, and with
one random offset u per source an item comes out floor(c * rank + u) - floor(c * (rank - 1) + u) times, that
is, once per integer boundary its interval crosses: c rounded down or up. As neighbours in that order have
about the same size, the size reached differs from its target by about one item.

Ranks of all items without gathering a source: the rows are range-partitioned by (source, size, id) and
written once; a row's rank is its place in its partition plus the rows of its source in earlier ones.

Default total: the largest for which every source that has items reaches its share within its repeats. A source
without items reaches 0; its share goes to the others in proportion. With a larger total, sources at their cap
fall short, which the reported shares show.

Items without source, id or size, of size 0 or less, and of sources without a target are in no mix. Equal items
are separate ones. Empty tables give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from yieldloom.operators.lots import small
from yieldloom.session import materialize


def ranked(items: DataFrame, partitions: int | None = None) -> DataFrame:
    """items: source, id, size. Adds rank, from 1 on in the order of (size, id) within the source."""
    rows = items.select("source", "id", F.col("size").cast("long").alias("size")).filter("source is not null and id is not null and size > 0")
    order = ["source", "size", "id"]
    spark = items.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*order, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    placed = materialize(placed, "ranked")
    # One row per source and partition.
    runs = placed.groupBy("source", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = small(materialize(runs.select("source", "part", "first", before.alias("before")), "runs"))
    return placed.join(runs, ["source", "part"]).select("source", "id", "size", (F.col("place") - F.col("first") + F.col("before") + 1).alias("rank"))


def copies_plan(items: DataFrame, weights: DataFrame, total: float | None = None, seed: int = 0) -> DataFrame:
    """One row per source of weights (source, target_share, max_repeats): its size, expected copies and offset."""
    sizes = items.groupBy("source").agg(F.sum("size").alias("own"), F.count(F.lit(1)).alias("items"))
    everything = W.partitionBy(F.lit(1))  # as many rows as weights has
    t = weights.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    t = t.join(sizes, "source", "left").withColumn("there", F.when(F.col("own") > 0, F.col("target_share")))
    t = t.withColumn("share", F.col("there") / F.sum("there").over(everything))
    most = F.min(F.when(F.col("share") > 0, F.col("own") * F.col("max_repeats") / F.col("share"))).over(everything)
    t = t.withColumn("total", F.lit(float(total)) if total is not None else most)
    c = F.least(F.col("total") * F.col("share") / F.col("own"), F.col("max_repeats").cast("double"))
    t = t.withColumn("expected", c).withColumn("expected", F.when(F.abs(F.col("expected") - F.round("expected")) < 1e-9, F.round("expected")).otherwise(F.col("expected")))
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1000)) / 1000.0
    return t.select("source", "target_share", "max_repeats", "own", "items", "expected", offset.alias("u"))


def mix(items: DataFrame, weights: DataFrame, total: float | None = None, seed: int = 0) -> DataFrame:
    """One row per copy in the mix: source, id, size, copy (from 1)."""
    r = ranked(items)
    plan = F.broadcast(copies_plan(r, weights, total, seed).select("source", "expected", "u").filter("expected > 0"))
    times = F.floor(F.col("expected") * F.col("rank") + F.col("u")) - F.floor(F.col("expected") * (F.col("rank") - 1) + F.col("u"))
    out = r.join(plan, "source").withColumn("times", times.cast("int")).filter("times > 0")
    return out.select("source", "id", "size", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))


def shares(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """Per source of weights: target_share, size and share reached, different items and most copies of one."""
    got = mixed.groupBy("source").agg(F.sum("size").alias("size"), F.count_if(F.col("copy") == 1).alias("items"), F.max("copy").alias("most_copies"))
    t = weights.select("source", "target_share", "max_repeats").join(got, "source", "left").fillna(0, ["size", "items", "most_copies"])
    return t.withColumn("share", F.when(F.sum("size").over(W.partitionBy(F.lit(1))) > 0, F.col("size") / F.sum("size").over(W.partitionBy(F.lit(1)))).otherwise(0.0))
