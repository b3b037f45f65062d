"""Order-dependent columns without a task per channel.

``sample`` counts 0, 1, 2, ... along a channel, so a channel can be cut into blocks of
samples.  A row near a block's edge is sent to the neighbouring block too (a halo), which
makes lag and lead exact in one shuffle; running sums add up block totals, of which there
are few, and add them to the sums within blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavemill.recording import SERIES
from wavemill.scratch import settle

BLOCK = 1 << 18


def neighbours(df: DataFrame, columns: Mapping[str, tuple[str, int]], keys: Sequence[str] = SERIES, block: int = BLOCK, order: str = "sample") -> DataFrame:
    """Adds, for each name -> (column, offset), the column's value ``offset`` samples further
    on (negative: back); null beyond either end."""
    reach = max(abs(o) for _, o in columns.values())
    own = F.floor(F.col(order) / block)
    ends = F.array_distinct(F.array(own, F.floor((F.col(order) - reach) / block), F.floor((F.col(order) + reach) / block)))
    rows = df.withColumn("__own", own).withColumn("__block", F.explode(ends))
    w = Window.partitionBy(*keys, "__block").orderBy(order)
    for name, (column, offset) in columns.items():
        rows = rows.withColumn(name, F.lead(column, offset).over(w) if offset > 0 else F.lag(column, -offset).over(w))
    return rows.where(F.col("__own") == F.col("__block")).drop("__own", "__block")


def running_sum(df: DataFrame, sums: Mapping[str, Column], keys: Sequence[str] = SERIES, block: int = BLOCK, order: str = "sample") -> DataFrame:
    """Adds the running total of each expression along the channel, the row included."""
    rows = df.withColumn("__block", F.floor(F.col(order) / block))
    for name, c in sums.items():
        rows = rows.withColumn(f"__x_{name}", c)
    inner = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "__block").agg(*(F.sum(f"__x_{n}").alias(f"__t_{n}") for n in sums))
    totals = totals.select(*keys, "__block", *(F.coalesce(F.sum(f"__t_{n}").over(outer), F.lit(0)).alias(f"__b_{n}") for n in sums))
    rows = rows.join(settle(totals), [*keys, "__block"])
    for name in sums:
        rows = rows.withColumn(name, F.coalesce(F.sum(f"__x_{name}").over(inner), F.lit(0)) + F.col(f"__b_{name}"))
    return rows.drop("__block", *(f"__{p}_{n}" for n in sums for p in "xb"))
