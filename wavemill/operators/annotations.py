"""Measurements on annotations: points in groups, markers, guide lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def point_deltas(points: DataFrame, keys: Sequence[str] = ("grp",), order: str = "idx") -> DataFrame:
    """For (keys, order, x, y) the step from the point before: dx, dy, 1/dx (null at 0), length."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = points.withColumn("dx", F.col("x") - F.lag("x").over(w)).withColumn("dy", F.col("y") - F.lag("y").over(w))
    return rows.withColumn("inverse_dx", F.when(F.col("dx") != 0, 1 / F.col("dx"))).withColumn("length", F.hypot("dx", "dy"))


def distinct_annotations(annotations: DataFrame) -> DataFrame:
    """One of each set of equal annotations of a mode (mode, kind, x, y)."""
    return annotations.dropDuplicates(["mode", "kind", "x", "y"])


def annotation_counts(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("mode", "kind").agg(F.count("*").alias("n"))


def spline(points: DataFrame, steps: int = 8, keys: Sequence[str] = ("grp",), order: str = "idx") -> DataFrame:
    """A Catmull-Rom curve through the points, ``steps`` places a segment, and the last point."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = points
    for c in "xy":
        rows = rows.withColumn(f"{c}2", F.lead(c).over(w)).withColumn(f"{c}0", F.coalesce(F.lag(c).over(w), c)).withColumn(f"{c}3", F.coalesce(F.lead(c, 2).over(w), F.lead(c).over(w)))
    rows = rows.withColumn("step", F.explode(F.when(F.col("x2").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(steps - 1)))))
    u = F.col("step") / steps

    def curve(c):
        p0, p1, p2, p3 = (F.col(n) for n in (f"{c}0", c, f"{c}2", f"{c}3"))
        bend = 0.5 * (2 * p1 + (p2 - p0) * u + (2 * p0 - 5 * p1 + 4 * p2 - p3) * u * u + (3 * p1 - p0 - 3 * p2 + p3) * u * u * u)
        return F.when(F.col(f"{c}2").isNull(), p1).otherwise(bend)

    return rows.select(*keys, order, "step", curve("x").alias("x"), curve("y").alias("y"))
