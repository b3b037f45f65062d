"""The part of an axis that is looked at: zoom, pan and clamp.  A view never changes data."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators.timeline import display_to_time, segments


@dataclass(frozen=True)
class View:
    """[start, end] within [low, high], never narrower than ``least`` unless all of it is."""

    start: float
    end: float
    low: float
    high: float
    least: float = 0.0

    def clamped(self) -> View:
        """The same width (not below the least, not above the whole), moved within the bounds."""
        width = min(max(self.end - self.start, self.least), self.high - self.low)
        start = min(max(self.start, self.low), self.high - width)
        return replace(self, start=start, end=start + width)

    def zoom(self, factor: float, around: float = 0.5) -> View:
        """``factor`` times the width; the place at the fraction ``around`` of the view stays where it is."""
        width = self.end - self.start
        new = min(max(width * factor, self.least), self.high - self.low)
        start = self.start + (width - new) * around
        return replace(self, start=start, end=start + new).clamped()

    def pan(self, fraction: float) -> View:
        """Moved by a fraction of its width."""
        by = (self.end - self.start) * fraction
        return replace(self, start=self.start + by, end=self.end + by).clamped()


def time_view(long: DataFrame, step: float) -> View:
    """All of a recording's time; ``step`` is its sample spacing."""
    lo, hi = long.agg(F.min("t"), F.max("t")).first()
    return View(lo, hi, lo, hi, max(step / 2, (hi - lo) * 1e-6))


def spectrum_view(bins: DataFrame) -> View:
    """All of a spectrum from 0 on; half a bin is the least."""
    top, step = bins.agg(F.max("freq"), F.max(F.when(F.col("bin") == 1, F.col("freq")))).first()
    return View(0.0, top, 0.0, top, step / 2)


def stitched_bounds(long: DataFrame, view: View) -> DataFrame:
    """(keys, start, end) in time, for each channel, of a view of its axis without gaps."""
    segs = segments(long)
    keys = segs.select("recording_id", "channel").distinct()
    ends = keys.withColumn("display", F.explode(F.array(F.lit(view.start), F.lit(view.end)))).withColumn("which", F.col("display") == view.end)
    back = display_to_time(ends, segs)
    return back.groupBy("recording_id", "channel").agg(F.min("t").alias("start"), F.max("t").alias("end"))
