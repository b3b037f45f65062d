"""Selection, statistics and summaries of recordings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.recording import SERIES, RecordingError, finite


def select_channels(long: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Channels in the order asked for (column ``position``); repeats are kept."""
    if not channels:
        raise RecordingError("InvalidChannels", "no channel is asked for")
    where: dict[str, list[int]] = {}
    for i, c in enumerate(channels):
        where.setdefault(c, []).append(i)
    table = F.create_map(*[x for c, at in where.items() for x in (F.lit(c), F.array(*map(F.lit, at)))])
    return long.where(F.col("channel").isin(*where)).withColumn("position", F.explode(table[F.col("channel")]))


def channel_positions(names: Sequence[str], positions: Sequence[int]) -> list[str]:
    """Names at 1-based positions; a position out of range is an error."""
    for p in positions:
        if not 1 <= p <= len(names):
            raise RecordingError("InvalidChannels", f"channel {p} is not among 1 to {len(names)}")
    return [names[p - 1] for p in positions]


def time_range(long: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Samples with start <= t <= end; both bounds must be finite and in order."""
    for bound in (start, end):
        if bound is not None and not math.isfinite(bound):
            raise RecordingError("InvalidTime", "bounds must be finite")
    if start is not None and end is not None and start > end:
        raise RecordingError("InvalidTime", "the start lies after the end")
    if start is not None:
        long = long.where(F.col("t") >= start)
    return long if end is None else long.where(F.col("t") <= end)


def resolve_range(long: DataFrame, start: float, end: float, clamp: bool = False) -> tuple[float, float]:
    """The interval within the recording's bounds: rejected beyond them, or clamped."""
    lo, hi = long.agg(F.min("t"), F.max("t")).first()
    if lo is None:
        raise RecordingError("TooShort", "the recording is empty")
    if clamp:
        start, end = max(start, lo), min(end, hi)
    if not (math.isfinite(start) and math.isfinite(end)) or start > end or start < lo or end > hi:
        raise RecordingError("InvalidTime", f"[{start}, {end}] is not within [{lo}, {hi}]")
    return start, end


def channel_stats(long: DataFrame) -> DataFrame:
    """Count of present values, least, greatest and mean value of each channel."""
    return long.groupBy(*SERIES).agg(F.count("value").alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"))


def recording_info(long: DataFrame) -> DataFrame:
    """Rows, channels and time bounds of each recording.

    The number of rows is that of the longest channel: channels are aligned."""
    per = long.groupBy(*SERIES).agg(F.count("*").alias("rows"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    return per.groupBy("recording_id").agg(F.max("rows").alias("n_rows"), F.count("*").alias("n_channels"), F.min("t0").alias("t_start"), F.max("t1").alias("t_end"))


def head(long: DataFrame, n: int) -> DataFrame:
    """The first n samples of every channel; ``sample`` counts from 0, so this is a filter."""
    if n < 0:
        raise RecordingError("InvalidOptions", "n must not be negative")
    return long.where(F.col("sample") < n)


def envelope(long: DataFrame, lo: int, hi: int) -> DataFrame:
    """Least and greatest finite value of samples lo <= sample < hi."""
    inside = long.where((F.col("sample") >= lo) & (F.col("sample") < hi) & finite(F.col("value")))
    return inside.groupBy(*SERIES).agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("*").alias("n"))


def sample_range(long: DataFrame, start: float, end: float) -> DataFrame:
    """First sample at or after start, and one past the last at or before end (bounds swap
    if reversed); of an empty range both are the place where it would be."""
    start, end = min(start, end), max(start, end)
    return long.groupBy(*SERIES).agg(F.sum((F.col("t") < start).cast("long")).alias("first"), F.sum((F.col("t") <= end).cast("long")).alias("past"))


def auto_y_time(long: DataFrame, pad: float = 0.05) -> DataFrame:
    """Bounds of the value axis: least and greatest finite value and a margin; -1 to 1 of
    nothing; a flat signal gets one unit either side."""
    got = long.groupBy("recording_id").agg(F.min(F.when(finite(F.col("value")), F.col("value"))).alias("lo"), F.max(F.when(finite(F.col("value")), F.col("value"))).alias("hi"))
    lo, hi = F.coalesce("lo", F.lit(-1.0)), F.coalesce("hi", F.lit(1.0))
    margin = F.when(hi > lo, (hi - lo) * pad).otherwise(F.when(F.col("lo").isNull(), 0.0).otherwise(1.0))
    return got.select("recording_id", (lo - margin).alias("y_lo"), (hi + margin).alias("y_hi"))


def auto_y_peak(spectrum: DataFrame, column: str, factor: float) -> DataFrame:
    """Upper bound of an axis that starts at 0: the greatest finite value times a factor, else 1."""
    top = F.max(F.when(finite(F.col(column)), F.col(column)))
    return spectrum.groupBy("recording_id").agg(F.when(top > 0, top * factor).otherwise(1.0).alias("y_hi"))
