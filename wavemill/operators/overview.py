"""Overviews: min/max buckets, views for a viewport, exact nearest samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavemill.operators.timeline import intervals
from wavemill.recording import SERIES, RecordingError, finite

LEAF = 1024
POINT = ("sample", "t", "value")


def _aggregates() -> list[Column]:
    """First, last, lowest and highest finite point; of equal values the earliest sample's."""
    ok = finite(F.col("value")) & finite(F.col("t"))
    when = lambda c: F.when(ok, c)
    return [
        F.min(when(F.struct(*POINT))).alias("first"),
        F.max(when(F.struct(*POINT))).alias("last"),
        F.min(when(F.struct("value", "sample", "t"))).alias("low"),
        F.max(when(F.struct(F.col("value"), (-F.col("sample")).alias("sample"), "t"))).alias("high"),
        F.sum(ok.cast("long")).alias("finite_count"),
        F.count("*").alias("sample_count"),
        F.max("dt").alias("max_spacing"),
    ]


def _points(df: DataFrame, *keys: str, extra: Sequence[str] = ()) -> DataFrame:
    p = lambda s, sign="": F.struct(F.expr(f"{sign}{s}.sample").alias("sample"), F.col(f"{s}.t").alias("t"), F.col(f"{s}.value").alias("value"))
    held = lambda s, c: F.when(F.col(s).isNotNull(), c)
    return df.select(*keys, "first", "last", held("low", p("low")).alias("low"), held("high", p("high", "-")).alias("high"), "finite_count", "sample_count", "max_spacing", *extra)


def build_overview(long: DataFrame, leaf: int = LEAF) -> DataFrame:
    """One row for each ``leaf`` samples of a channel; the spacing counted is the one before
    each sample within its bucket."""
    rows = intervals(long).withColumn("bucket", F.floor(F.col("sample") / leaf))
    rows = rows.withColumn("dt", F.when(F.col("sample") % leaf != 0, F.col("dt")))
    return _points(rows.groupBy(*SERIES, "bucket").agg(*_aggregates()), *SERIES, "bucket")


def merge_overview(overview: DataFrame, factor: int = 2) -> DataFrame:
    """The next level: buckets of ``factor`` buckets, from the buckets alone.

    Spacing across a seam is the time from the last point of one to the first of the next."""
    w = Window.partitionBy(*SERIES, F.floor(F.col("bucket") / factor)).orderBy("bucket")
    rows = overview.withColumn("__seam", F.col("first.t") - F.lag("last.t").over(w)).withColumn("bucket", F.floor(F.col("bucket") / factor))
    return _merged(rows.withColumn("max_spacing", F.greatest("max_spacing", "__seam")))


def _merged(rows: DataFrame, **extra: Column) -> DataFrame:
    """Rows of one bucket together, with further aggregates."""
    got = rows.groupBy(*SERIES, "bucket").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.min(F.when(F.col("low").isNotNull(), F.struct("low.value", "low.sample", "low.t"))).alias("low"),
        F.max(F.when(F.col("high").isNotNull(), F.struct("high.value", (-F.col("high.sample")).alias("sample"), "high.t"))).alias("high"),
        F.sum("finite_count").alias("finite_count"),
        F.sum("sample_count").alias("sample_count"),
        F.max("max_spacing").alias("max_spacing"),
        *(c.alias(n) for n, c in extra.items()),
    )
    return _points(got, *SERIES, "bucket", extra=tuple(extra))


def bucket_points(overview: DataFrame, threshold: float | None = None) -> DataFrame:
    """At most four points a bucket in the order of samples, and whether the line breaks there:
    a sample is missing, or the spacing exceeds the threshold."""
    four = F.array_sort(F.array_distinct(F.filter(F.array("first", "low", "high", "last"), lambda p: p.isNotNull())))
    broken = F.col("finite_count") != F.col("sample_count")
    if threshold is not None:
        broken = broken | F.coalesce(F.col("max_spacing") > threshold, F.lit(False))
    return overview.select(*SERIES, "bucket", broken.alias("broken"), F.explode(four).alias("p")).select(*SERIES, "bucket", "broken", "p.*")


def view(long: DataFrame, start: float, end: float, pixels: int) -> DataFrame:
    """The overview of [start, end] with a bucket for each pixel column, from the samples."""
    if pixels < 1 or not start < end:
        raise RecordingError("InvalidOptions", "a view needs pixels and a width")
    inside = intervals(long).where((F.col("t") >= start) & (F.col("t") <= end))
    pixel = F.least(F.floor((F.col("t") - start) / (end - start) * pixels), F.lit(pixels - 1))
    return _points(inside.withColumn("bucket", pixel).groupBy(*SERIES, "bucket").agg(*_aggregates()), *SERIES, "bucket")


def view_of(overview: DataFrame, long: DataFrame, start: float, end: float, pixels: int, leaf: int = LEAF) -> DataFrame:
    """The same view (but for max_spacing) of a recording whose times increase, from its overview
    of ``leaf`` samples a bucket: buckets that lie within a pixel column are taken as they are,
    samples are read only of those that cross a border or miss values."""
    if pixels < 1 or not start < end:
        raise RecordingError("InvalidOptions", "a view needs pixels and a width")

    def pixel(t):
        return F.least(F.floor((t - start) / (end - start) * pixels), F.lit(pixels - 1))

    first, last = F.col("first.t"), F.col("last.t")
    near = overview.where(first.isNull() | (first <= end) & (last >= start) | (F.col("finite_count") < F.col("sample_count")))
    whole = F.coalesce((F.col("finite_count") == F.col("sample_count")) & (first >= start) & (last <= end) & (pixel(first) == pixel(last)), F.lit(False))
    taken = near.where(whole).withColumn("bucket", pixel(first))
    crossing = near.where(~whole).select(*SERIES, "bucket")
    rows = long.withColumn("bucket", F.floor(F.col("sample") / leaf)).join(crossing, [*SERIES, "bucket"], "left_semi")
    rows = rows.where((F.col("t") >= start) & (F.col("t") <= end)).withColumn("bucket", pixel(F.col("t"))).withColumn("dt", F.lit(None).cast("double"))
    read = _points(rows.groupBy(*SERIES, "bucket").agg(*_aggregates()), *SERIES, "bucket")
    return _merged(taken.unionByName(read)).drop("max_spacing")


def pixel_range(long: DataFrame, start: float, end: float, pixels: int) -> DataFrame:
    """Lowest and highest value of each pixel column."""
    return view(long, start, end, pixels).select(*SERIES, F.col("bucket").alias("pixel"), F.col("low.value").alias("min_value"), F.col("high.value").alias("max_value"))


def nearest_sample(long: DataFrame, t: float, value: float, t_scale: float = 1.0, value_scale: float = 1.0, channels: Sequence[str] | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
    """The finite sample nearest to a place, by (dt * t_scale)^2 + (dvalue * value_scale)^2;
    ties go to the channel that is named first, then to the earlier sample.

    One row at most; a top-1, so every task sends a single row."""
    rows = long.where(finite(F.col("value")) & finite(F.col("t")))
    rank = F.lit(0)
    if channels is not None:
        rows = rows.where(F.col("channel").isin(*channels))
        rank = F.array_position(F.array(*map(F.lit, channels)), F.col("channel"))
    if start is not None:
        rows = rows.where(F.col("t") >= start)
    if end is not None:
        rows = rows.where(F.col("t") <= end)
    d = F.pow((F.col("t") - t) * t_scale, 2) + F.pow((F.col("value") - value) * value_scale, 2)
    return rows.withColumn("rank", rank.cast("long")).withColumn("distance", d).orderBy("distance", "rank", "channel", "sample").limit(1)
