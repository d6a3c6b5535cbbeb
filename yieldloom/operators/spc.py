"""Process capability and control-chart rules per source (step, tool, parameter).

Null and NaN readings are dropped first, as the rules count readings. Control-chart windows need the seven
readings before each one. A source may hold a third of all rows, so its readings are range-partitioned by
time into chunks, and each chunk gets the last seven readings before it as context; windows then run within
chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from yieldloom.operators import lots as ops
from yieldloom.operators.lots import KEY
from yieldloom.session import materialize


def cpk(mean: Column, sd: Column, n: Column, low: Column, high: Column) -> Column:
    """Process capability; null for n < 2 or without limits; without scatter 0 outside of the limits, else 9.99."""
    flat = F.when(F.coalesce(mean < low, F.lit(False)) | F.coalesce(mean > high, F.lit(False)), 0.0).otherwise(9.99)
    # least() skips the side without a limit.
    sides = F.least((high - mean) / (3 * sd), (mean - low) / (3 * sd))
    return F.when((n < 2) | (low.isNull() & high.isNull()), F.lit(None).cast("double")).when(sd <= 1e-12, flat).otherwise(sides)


def out_of_capability(c: Column, threshold: float = 1.33) -> Column:
    return F.coalesce(c < threshold, F.lit(False))


def key_stats(steps: DataFrame) -> DataFrame:
    """Per source: n, mean, sd (0 for one reading), limits as first seen, last value; one map-side aggregation."""
    t = steps.filter("value is not null").groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
        F.min_by(F.struct("spec_min", "spec_max"), F.struct("ts", "id")).alias("limits"), F.max_by("value", F.struct("ts", "id")).alias("last_value"),
    )
    t = t.select(*KEY, "n", "mean", "sd", F.col("limits.spec_min").alias("spec_min"), F.col("limits.spec_max").alias("spec_max"), "last_value")
    return t.withColumn("cpk", cpk(*[F.col(c) for c in ("mean", "sd", "n", "spec_min", "spec_max")]))


def chunked(rows: DataFrame, keys: list[str], order: list[str], before: int, partitions: int | None = None) -> DataFrame:
    """The rows with a column chunk, and in each chunk, marked by context, up to `before` rows of the same key before it.

    Windows over (keys, chunk) with frames of at most `before` preceding rows then see what windows over keys would.
    A key spans several chunks only if its rows fill whole partitions, which are larger than `before`.
    """
    cols = [*keys, *order]
    ranged = rows.repartitionByRange(partitions, *cols) if partitions else rows.repartitionByRange(*cols)
    placed = ranged.sortWithinPartitions(*cols).withColumn("chunk", F.spark_partition_id())
    placed = materialize(placed, "chunks")
    runs = placed.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("_rows"))  # one row per key and chunk
    runs = runs.withColumn("_next", F.lead("chunk").over(W.partitionBy(*keys).orderBy("chunk"))).filter("_next is not null")
    last = F.row_number().over(W.partitionBy(*keys, "chunk").orderBy(*[F.desc(c) for c in order]))
    tails = placed.withColumn("_back", last).filter(F.col("_back") <= before).join(runs, [*keys, "chunk"])
    tails = tails.withColumn("chunk", F.col("_next")).select(*placed.columns, F.lit(True).alias("context"))
    return placed.withColumn("context", F.lit(False)).unionByName(tails)


def control_chart(steps: DataFrame, stats: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every reading with z against its source's mean and deviation and the four Western Electric rules; stats: best a written table.

    rule1: beyond 3 sigma. rule2: two of three beyond 2 on one side. rule3: four of five beyond 1 on one side.
    rule4: eight in a row on one side. A source without scatter counts deviations in units of 1e-6.
    """
    rows = steps.filter("value is not null").select(*KEY, "ts", "id", "lot_id", "value")
    t = chunked(rows, KEY, ["ts", "id"], before=7, partitions=partitions).join(ops.small(stats.select(*KEY, "mean", "sd")), KEY)
    t = t.withColumn("z", (F.col("value") - F.col("mean")) / F.when(F.col("sd") <= 1e-12, 1e-6).otherwise(F.col("sd")))
    w = W.partitionBy(*KEY, "chunk").orderBy("ts", "id")

    def among(last: int, least: int, limit: float) -> Column:
        frame = w.rowsBetween(1 - last, 0)
        full = F.count(F.lit(1)).over(frame) == last
        side = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(frame) >= least
        return full & (side(F.col("z") > limit) | side(F.col("z") < -limit))

    return t.select(
        *KEY, "id", "lot_id", "ts", "value", "z", "context", (F.abs("z") > 3).alias("rule1"),
        among(3, 2, 2.0).alias("rule2"), among(5, 4, 1.0).alias("rule3"), among(8, 8, 0.0).alias("rule4"),
    ).filter("not context").drop("context")


def violations(chart: DataFrame) -> DataFrame:
    """Per source how many readings violate each rule."""
    return chart.groupBy(*KEY).agg(*[F.count_if(f"rule{i}").alias(f"rule{i}") for i in range(1, 5)])


def summary(steps: DataFrame) -> DataFrame:
    """Capability, rule violations, latest value and its z per source."""
    stats = materialize(key_stats(steps), "stats")
    t = stats.join(violations(control_chart(steps, stats)), KEY, "left")
    z = F.when(F.col("sd") > 1e-12, (F.col("last_value") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return t.withColumn("out_of_capability", out_of_capability(F.col("cpk"))).withColumn("last_z", z)
