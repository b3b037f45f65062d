"""Operators for unbounded recordings.

Rows of a channel must arrive in order (a file per stretch, or one partition per channel);
each operator keeps a few numbers for a channel and gives the same result as its batch form,
however the stream is cut into micro-batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wavemill.clock import MonotonicClock
from wavemill.operators.filters import RESET_STEPS, FilterSettings, Linear, cascade
from wavemill.recording import LONG_SCHEMA, SERIES, finite


def _channel_rows(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(pdfs)).sort_values("sample")


def filter_stream(long: DataFrame, settings: FilterSettings) -> DataFrame:
    """The causal filter over a stream: state is two numbers a section, the last time and
    whether the filter is under way."""
    if not (settings.step > 0 and math.isfinite(settings.step)):
        return long
    sections, subtract = cascade(settings)
    if not sections:
        # Nothing is left of an open band-stop, as in the batch form.
        return long.withColumn("value", F.when(finite(F.col("value")) & finite(F.col("t")), 0.0).otherwise(F.col("value"))) if subtract else long
    linear, n, limit = Linear(sections), 2 * len(sections), RESET_STEPS * settings.step

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        z, before, under_way = state.get if state.exists else ([0.0] * n, 0.0, False)
        z, rows = np.array(z, float), _channel_rows(pdfs)
        t, x = rows["t"].to_numpy(float), rows["value"].to_numpy(float)
        out, begin = x.copy(), 0

        def close(end):
            nonlocal z
            if end > begin:
                y, z = linear.run(x[begin:end], z)
                out[begin:end] = x[begin:end] - y if subtract else y

        for i in range(len(x)):
            ok = math.isfinite(x[i]) and math.isfinite(t[i])
            if not ok or (under_way and not 0 < t[i] - before <= limit):
                close(i)
                z, begin = np.zeros(n), i if ok else i + 1
            before, under_way = float(t[i]), ok
        close(len(x))
        state.update((z.tolist(), before, bool(under_way)))
        yield rows.assign(value=out)[["recording_id", "channel", "sample", "t", "value"]]

    return long.groupBy(*SERIES).applyInPandasWithState(run, LONG_SCHEMA, "z array<double>, before double, under_way boolean", "append", GroupStateTimeout.NoTimeout)


def monotonic_stream(long: DataFrame) -> DataFrame:
    """Strictly increasing times over a stream: late or equal times move on, none is dropped."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock, rows = MonotonicClock(*state.get) if state.exists else MonotonicClock(), _channel_rows(pdfs)
        out = [clock.place(now) if math.isfinite(now) else None for now in rows["t"].to_numpy(float).tolist()]
        state.update((clock.source, clock.placed, clock.offset, clock.step))
        yield rows.assign(t=out)[["recording_id", "channel", "sample", "t", "value"]]

    return long.groupBy(*SERIES).applyInPandasWithState(run, LONG_SCHEMA, "source double, placed double, offset double, step double", "append", GroupStateTimeout.NoTimeout)


def bucket_stream(long: DataFrame, leaf: int = 1024) -> DataFrame:
    """Tumbling buckets of ``leaf`` samples: running lowest, highest and count of finite values
    (output mode update or complete)."""
    ok = ~F.isnan("value") & (F.abs("value") != float("inf"))
    return long.withColumn("bucket", F.floor(F.col("sample") / leaf)).groupBy(*SERIES, "bucket").agg(F.min(F.when(ok, F.col("value"))).alias("low"), F.max(F.when(ok, F.col("value"))).alias("high"), F.sum(ok.cast("long")).alias("finite_count"), F.count("*").alias("sample_count"))


def stats_stream(long: DataFrame) -> DataFrame:
    """Running count, bounds and mean of each channel (output mode update or complete)."""
    return long.groupBy(*SERIES).agg(F.count("value").alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"))


def session_stream(rows: DataFrame, gap_seconds: float, late: str = "0 seconds", ts: str = "ts") -> DataFrame:
    """Runs of samples with no gap beyond ``gap_seconds``, over an event-time column."""
    gap = f"{gap_seconds:.6f} seconds"
    return rows.withWatermark(ts, late).groupBy("channel", F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def welch_stream_windows(rows: DataFrame, length_seconds: float, late: str = "0 seconds", ts: str = "ts") -> DataFrame:
    """Sliding windows that overlap by half, as segments of a clocked signal do."""
    return rows.withWatermark(ts, late).groupBy("channel", F.window(ts, f"{length_seconds:.6f} seconds", f"{length_seconds / 2:.6f} seconds")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
