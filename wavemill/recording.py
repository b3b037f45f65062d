"""The canonical shape of a recording.

Long form, one row per sample of a channel:

    recording_id, channel, sample (0, 1, ... along each channel), t (seconds), value

A missing value is NULL (never NaN); infinities stay.  ``sample`` is the order of a channel:
``t`` may repeat or run backwards until it has been made monotonic.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavemill.scratch import settle

SERIES = ("recording_id", "channel")
LONG_SCHEMA = "recording_id string, channel string, sample long, t double, value double"


class RecordingError(ValueError):
    """A request that the data or its parameters don't allow; ``kind`` names the reason."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


SORTED = 1 << 20  # rows that one task may sort


def from_rows(df: DataFrame, t: Column, value: Column, channel: Column, order: Sequence[Column], recording_id: Column | None = None, block: int = SORTED) -> DataFrame:
    """Long form of any table; ``order`` must be a total order within a channel, its first column
    a number, date or timestamp.

    A table of more than ``block`` rows is cut into ranges of that first column, so that no
    task sorts a whole channel: rows are numbered within a range and begin at the number of
    rows of the ranges before it."""
    rid = recording_id if recording_id is not None else F.lit("r")
    first = order[0]
    kind = df.select(first).schema[0].dataType.typeName()
    first = F.unix_micros(first.cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(first) if kind == "date" else first
    rows = df.select(
        rid.cast("string").alias("recording_id"), channel.cast("string").alias("channel"), t.cast("double").alias("t"),
        nan_to_null(value.cast("double")).alias("value"), F.struct(*order).alias("__o"), first.cast("double").alias("__x"),
    )
    n, lo, hi = rows.agg(F.count("*"), F.min("__x"), F.max("__x")).first()
    within = [*SERIES]
    if n > block and hi > lo and math.isfinite(hi - lo):
        width = (hi - lo) / (4 * -(-n // block))
        rows = rows.withColumn("__range", F.coalesce(F.floor((F.col("__x") - lo) / width), F.lit(-1)))
        before = Window.partitionBy(*SERIES).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        held = rows.groupBy(*SERIES, "__range").agg(F.count("*").alias("__n"))
        held = held.select(*SERIES, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
        rows = rows.join(settle(held), [*SERIES, "__range"])
        within.append("__range")
    else:
        rows = rows.withColumn("__first", F.lit(0))
    w = Window.partitionBy(*within).orderBy("__o")
    return rows.withColumn("sample", (F.col("__first") + F.row_number().over(w) - 1).cast("long")).select(*SERIES, "sample", "t", "value")


def wide_to_long(wide: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(recording_id, sample, t, channel columns) to long form, without a shuffle."""
    pairs = F.array(*(F.struct(F.lit(c).alias("channel"), nan_to_null(F.col(f"`{c}`").cast("double")).alias("value")) for c in channels))
    return wide.select("recording_id", "sample", "t", F.explode(pairs).alias("p")).select("recording_id", "p.channel", "sample", "t", "p.value")


def long_to_wide(long: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One column per channel; the list of channels is given, so no job looks for it."""
    return long.groupBy("recording_id", "sample").agg(F.min("t").alias("t"), *(F.max(F.when(F.col("channel") == c, F.col("value"))).alias(c) for c in channels))
