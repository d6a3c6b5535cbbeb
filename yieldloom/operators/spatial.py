"""The spatial signature of the defects of a lot (or of any other grouping).

One aggregation gives zone shares, quadrants and the covariance; the main axis follows from it in closed form.
A second one gives the spread along the axis. Both aggregate on the map side, so a lot with a third of all
defects leaves each task as one row; the axes are joined to the defects by lot, where AQE splits a skewed lot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class SpatialConfig:
    min_points: int = 4
    center_radius: float = 0.35
    donut_inner: float = 0.30
    donut_outer: float = 0.80
    edge_radius: float = 0.72
    scratch_linearity: float = 0.88
    scratch_span: float = 0.35
    edge_share: float = 0.58
    edge_center_most: float = 0.15
    center_share: float = 0.48
    center_edge_most: float = 0.25
    donut_share: float = 0.55
    donut_center_most: float = 0.18
    donut_edge_most: float = 0.40
    quadrants: int = 3


def quadrant(x: Column, y: Column) -> Column:
    """0..3 counter-clockwise from the negative x axis."""
    pi = F.lit(3.141592653589793)
    return F.pmod(F.floor((F.atan2(y, x) + pi) / (pi / 2)).cast("int"), F.lit(4))


def shape(points: DataFrame, by: list[str], c: SpatialConfig = SpatialConfig()) -> DataFrame:
    """Per group: points, shares of the zones, quadrants, linearity and span along the main axis."""
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    share = lambda cond: F.avg(cond.cast("double"))
    t = points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("points"), share(r <= c.center_radius).alias("center"), share(r >= c.edge_radius).alias("edge"),
        share((r >= c.donut_inner) & (r <= c.donut_outer)).alias("donut"),
        F.bit_count(F.bit_or(F.pow(F.lit(2), quadrant(F.col("x"), F.col("y"))).cast("int"))).alias("quadrants"),
        F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy"),
    )
    half, diff = (F.col("vx") + F.col("vy")) / 2, (F.col("vx") - F.col("vy")) / 2
    top = half + F.sqrt(diff * diff + F.col("vxy") * F.col("vxy"))
    t = t.withColumn("linearity", F.when(2 * half > 1e-12, top / (2 * half)).otherwise(0.0)).withColumn("top", top)
    # The eigenvector of the larger eigenvalue; with no covariance, the axis of the larger variance.
    straight = F.abs("vxy") < 1e-15
    ax = F.when(straight, F.when(F.col("vx") >= F.col("vy"), 1.0).otherwise(0.0)).otherwise(F.col("top") - F.col("vy"))
    ay = F.when(straight, F.when(F.col("vx") >= F.col("vy"), 0.0).otherwise(1.0)).otherwise(F.col("vxy"))
    axes = t.filter(F.col("points") >= c.min_points).select(*by, ax.alias("ax"), ay.alias("ay"))
    on_axis = (F.col("x") * F.col("ax") + F.col("y") * F.col("ay")) / F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay"))
    span = points.select(*by, "x", "y").join(axes, by).groupBy(*by).agg((F.max(on_axis) - F.min(on_axis)).alias("span"))
    return t.drop("top").join(span, by, "left").withColumn("span", F.when(F.col("vx") + F.col("vy") > 1e-12, F.coalesce("span", F.lit(0.0))).otherwise(0.0))


def classify(shapes: DataFrame, c: SpatialConfig = SpatialConfig()) -> DataFrame:
    """Adds signature and confidence; the first pattern that fits counts."""
    few = F.col("points") < c.min_points
    scratch = (F.col("linearity") >= c.scratch_linearity) & (F.col("span") >= c.scratch_span) & ((F.col("edge") < 0.85) | (F.col("quadrants") <= 2))
    edge = (F.col("edge") >= c.edge_share) & (F.col("center") <= c.edge_center_most) & (F.col("quadrants") >= c.quadrants)
    center = (F.col("center") >= c.center_share) & (F.col("edge") <= c.center_edge_most)
    donut = (F.col("donut") >= c.donut_share) & (F.col("center") <= c.donut_center_most) & (F.col("edge") <= c.donut_edge_most) & (F.col("quadrants") >= c.quadrants)
    up_to = lambda base, slope, v: F.least(F.lit(0.95), base + slope * F.col(v))
    cases = [(few, "random", F.lit(0.5)), (scratch, "scratch", up_to(0.65, 0.30, "linearity")), (edge, "edge-ring", up_to(0.60, 0.35, "edge")),
             (center, "center-cluster", up_to(0.60, 0.35, "center")), (donut, "donut", up_to(0.60, 0.35, "donut"))]
    signature, confidence = F.lit("random"), F.lit(0.70)
    for cond, name, conf in reversed(cases):
        signature, confidence = F.when(cond, name).otherwise(signature), F.when(cond, conf).otherwise(confidence)
    return shapes.withColumn("signature", signature).withColumn("confidence", confidence)


def signatures(points: DataFrame, by: list[str] | None = None, c: SpatialConfig = SpatialConfig()) -> DataFrame:
    """points: the grouping columns, x, y. Rows without a place have no part in a signature; NaN counts as none."""
    placed = points.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    return classify(shape(placed, by or ["lot_id"], c), c)
