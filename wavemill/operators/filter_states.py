"""Stored states of filters, so that an interval of a long recording is filtered on its own.

One pass over a recording writes, for each block of samples, the state the filter has before
it, whether it starts afresh at its first sample, and the block's bounds in time.  An interval
then needs only the blocks it meets: each is run from its own state, and equals the same
samples of a run over everything.  Tables are named by the filter's settings, the block, what
was done to the values before (``recipe``) and the state of the source (``stamp``), so another
recipe or a changed source never finds states that aren't its own.
"""

from __future__ import annotations

import hashlib
from dataclasses import astuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators.filters import BLOCK, FilterSettings, _unchanged, block_rows, block_states, run_blocks
from wavemill.recording import SERIES, RecordingError, finite
from wavemill.scratch import exists

KEYS = (*SERIES, "block")


class FilterStates:
    """A folder of stored states."""

    def __init__(self, folder: str, block: int = BLOCK):
        if block < 1:
            raise RecordingError("InvalidOptions", "a block needs samples")
        self.folder, self.block = folder.rstrip("/"), block

    def path(self, settings: FilterSettings, stamp: str, recipe: str = "") -> str:
        name = "\n".join([*map(repr, astuple(settings)), str(self.block), stamp, recipe])
        return f"{self.folder}/states-{hashlib.sha256(name.encode()).hexdigest()[:32]}"

    def states(self, long: DataFrame, settings: FilterSettings, stamp: str, recipe: str = "") -> DataFrame:
        """(recording_id, channel, block, start, first_reset, t_low, t_high): read, or made by one
        pass over all of ``long`` and stored.  A pass that fails stores nothing that is read."""
        path = self.path(settings, stamp, recipe)
        if not exists(long.sparkSession, f"{path}/_SUCCESS"):
            rows = block_rows(long, settings, self.block)
            t = F.when(finite(F.col("t")), F.col("t"))
            facts = rows.groupBy(*KEYS).agg(F.min_by("reset", "sample").alias("first_reset"), F.min(t).alias("t_low"), F.max(t).alias("t_high"))
            made = block_states(rows, settings).join(facts, list(KEYS))
            made.sortWithinPartitions(*KEYS).write.mode("overwrite").parquet(path)
        return long.sparkSession.read.parquet(path)

    def filter_interval(self, long: DataFrame, settings: FilterSettings, stamp: str, start: float | None = None, end: float | None = None, recipe: str = "") -> DataFrame:
        """The samples with start <= t <= end of the filtered recording ``long``.

        Of ``long`` only the blocks that meet the interval are read: their range of samples is a
        filter on ``sample``, which Parquet and recording files take over.  Samples without a
        finite time have no place in an interval; without bounds they stay."""
        low, high = F.lit(float("-inf") if start is None else start), F.lit(float("inf") if end is None else end)
        inside = (F.col("t") >= low) & (F.col("t") <= high)
        if start is None and end is None:
            inside = F.lit(True)
        out = _unchanged(long, settings)
        if out is not None:
            return out.where(inside)
        states = self.states(long, settings, stamp, recipe)
        if start is not None or end is not None:
            states = states.where((F.col("t_low") <= high) & (F.col("t_high") >= low))
        first, last = states.agg(F.min("block"), F.max("block")).first()
        if first is None:
            return long.limit(0)
        near = long.where((F.col("sample") >= first * self.block) & (F.col("sample") < (last + 1) * self.block))
        near = near.withColumn("block", F.floor(F.col("sample") / self.block).cast("long")).join(states.select(*KEYS), list(KEYS), "left_semi").drop("block")
        rows = block_rows(near, settings, self.block).join(states.select(*KEYS, "first_reset"), list(KEYS))
        # What stands before a block's first sample wasn't read; the pass over everything knew it.
        rows = rows.withColumn("reset", F.when(F.col("sample") % self.block == 0, F.col("first_reset")).otherwise(F.col("reset"))).drop("first_reset")
        return run_blocks(rows, states.select(*KEYS, "start"), settings, list(long.columns)).where(inside)
