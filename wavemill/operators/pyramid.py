"""A stored pyramid of boxes over a recording, for views and searches that read little of it.

Level 0 has a box for each ``leaf`` samples of a channel; a box of the next level covers ``fan``
boxes of the one below, up to one box a channel.  A box holds its bounds in time and value,
its first, last, lowest and highest finite point, its counts and its widest spacing (the
spacing before its first sample included, so boxes merge without looking at their seams).

On disk: ``samples`` in ranges of (channel, box), so that Parquet's statistics skip what isn't
asked for, ``levels`` partitioned by level, and ``facts``, written last: a folder without
them is an unfinished one and is written again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.operators.overview import LEAF, _aggregates, _merged, _points
from wavemill.operators.timeline import intervals
from wavemill.recording import SERIES, RecordingError, finite
from wavemill.scratch import Scratch, exists

FAN = 16
PUSHED = 4096  # places in a table that are handed to its scan as ranges; more go through the join alone
RANGES = 64
BOUNDS = ("t_low", "t_high", "timed_count")


def build_pyramid(long: DataFrame, path: str, leaf: int = LEAF, fan: int = FAN, stamp: str = "") -> Pyramid:
    """Writes the pyramid of a recording to a folder, or opens the one that is there already.

    ``stamp`` says which state of the source it was made from."""
    if leaf < 1 or fan < 2:
        raise RecordingError("InvalidOptions", "a pyramid needs leaves of samples and at least two boxes in one")
    spark = long.sparkSession
    if exists(spark, f"{path}/facts"):
        return Pyramid(spark, path, stamp)
    rows = intervals(long).select(*SERIES, F.floor(F.col("sample") / leaf).cast("long").alias("bucket"), "sample", "t", "value", "dt")
    ranges = rows.repartitionByRange(*SERIES, "bucket").sortWithinPartitions(*SERIES, "bucket", "sample")
    ranges.write.mode("overwrite").parquet(f"{path}/samples")
    timed = F.when(finite(F.col("t")), F.col("t"))
    boxes = spark.read.parquet(f"{path}/samples").groupBy(*SERIES, "bucket")
    boxes = boxes.agg(*_aggregates(), F.min(timed).alias("t_low"), F.max(timed).alias("t_high"), F.count(timed).alias("timed_count"))
    boxes, level = _points(boxes, *SERIES, "bucket", extra=BOUNDS), 0
    while True:
        place = f"{path}/levels/level={level}"
        boxes.repartitionByRange(*SERIES, "bucket").sortWithinPartitions(*SERIES, "bucket").write.mode("overwrite").parquet(place)
        written = spark.read.parquet(place)
        if not written.agg(F.max("bucket")).first()[0]:
            break
        level += 1
        boxes = _merged(written.withColumn("bucket", F.floor(F.col("bucket") / fan)), t_low=F.min("t_low"), t_high=F.max("t_high"), timed_count=F.sum("timed_count"))
    facts = spark.createDataFrame([(leaf, fan, level, stamp)], "leaf long, fan long, top int, stamp string")
    facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
    return Pyramid(spark, path, stamp)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys, where missing ones count as equal."""
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(right[k])
    return same


def _pairs(columns: Sequence[tuple[str, str]]) -> Column:
    """Columns that are equal in pairs, where missing values count as equal."""
    same = F.lit(True)
    for a, b in columns:
        same = same & F.col(a).eqNullSafe(F.col(b))
    return same


def _ranges(buckets: Sequence[int], most: int = RANGES) -> list[tuple[int, int]]:
    """Few ranges that hold all these numbers, left apart at the widest gaps between them."""
    at = sorted(set(buckets))
    cuts = sorted(range(1, len(at)), key=lambda i: at[i - 1] - at[i])[: most - 1]
    cuts = sorted(i for i in cuts if at[i] - at[i - 1] > 1)
    return [(at[a], at[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(at)])]


class Pyramid:
    """A pyramid that lies in a folder."""

    def __init__(self, spark: SparkSession, path: str, stamp: str = ""):
        if not exists(spark, f"{path}/facts"):
            raise RecordingError("ReadFailure", f"no finished pyramid in {path}")
        facts = spark.read.parquet(f"{path}/facts").first()
        if facts["stamp"] != stamp:
            raise RecordingError("SourceChanged", f"{path} was made from another state of its source")
        self.spark, self.path, self.leaf, self.fan, self.top = spark, path, facts["leaf"], facts["fan"], facts["top"]

    def samples(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/samples")

    def boxes(self, level: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/levels/level={level}")

    def _known(self, wanted: DataFrame, scratch: Scratch) -> tuple[DataFrame, list | None]:
        """(keys, bucket) computed once, and as a list where there are few."""
        wanted = scratch.save(wanted.select(*SERIES, "bucket").distinct())
        few = wanted.limit(PUSHED + 1).collect()
        return wanted, few if len(few) <= PUSHED else None

    def _at(self, table: DataFrame, wanted: DataFrame, few: list | None) -> DataFrame:
        """The table's rows of these buckets.  Of few buckets the scan is given ranges."""
        if few is not None:
            inside = F.lit(False)
            for a, b in _ranges([r["bucket"] for r in few]) if few else ():
                inside = inside | F.col("bucket").between(a, b)
            table = table.where(inside)
            names = {r["channel"] for r in few}
            if len(names) <= RANGES and None not in names:
                table = table.where(F.col("channel").isin(*sorted(names)))
        return table.join(wanted, _same(table, wanted, [*SERIES, "bucket"]), "left_semi")

    def _children(self, wanted: DataFrame, few: list | None) -> tuple[DataFrame, list | None]:
        """The boxes below these, in the same two forms."""
        fan = self.fan
        below = wanted.withColumn("bucket", F.explode(F.sequence(F.col("bucket") * fan, F.col("bucket") * fan + fan - 1)))
        return below, few and [{"channel": r["channel"], "bucket": r["bucket"] * fan + i} for r in few for i in range(fan)]

    def view_parts(self, start: float, end: float, pixels: int, channels: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(boxes that lie within one pixel column, leaves whose samples must be read).

        From the top down, only the boxes that cross a border of a pixel column are opened: of a
        channel whose times increase, at most pixels + 1 on each level."""
        if pixels < 1 or not start < end:
            raise RecordingError("InvalidOptions", "a view needs pixels and a width")
        scratch, taken = Scratch(self.spark), None
        boxes = self.boxes(self.top)
        if channels is not None:
            boxes = boxes.where(F.col("channel").isin(*channels))
        for level in range(self.top, -1, -1):
            near = boxes.where((F.col("t_low") <= end) & (F.col("t_high") >= start))
            low, high = _pixel("t_low", start, end, pixels), _pixel("t_high", start, end, pixels)
            whole = (F.col("t_low") >= start) & (F.col("t_high") <= end) & (low == high)
            part = near.where(whole).withColumn("bucket", low)
            taken = part if taken is None else taken.unionByName(part)
            crossing, few = self._known(near.where(~whole), scratch)
            if level:
                below, list_below = self._children(crossing, few)
                boxes = self._at(self.boxes(level - 1), below, list_below)
        return taken, crossing

    def view(self, start: float, end: float, pixels: int, channels: Sequence[str] | None = None) -> DataFrame:
        """What ``overview.view`` gives from the samples, of whatever axis."""
        taken, crossing = self.view_parts(start, end, pixels, channels)
        few = crossing.limit(PUSHED + 1).collect()
        rows = self._at(self.samples(), crossing, few if len(few) <= PUSHED else None)
        rows = rows.where((F.col("t") >= start) & (F.col("t") <= end)).withColumn("bucket", _pixel("t", start, end, pixels))
        read = _points(rows.groupBy(*SERIES, "bucket").agg(*_aggregates()), *SERIES, "bucket")
        return _merged(taken.withColumn("sample_count", F.col("timed_count")).drop(*BOUNDS).unionByName(read))

    def nearest(
        self, places: DataFrame, t_scale: float = 1.0, value_scale: float = 1.0, channels: Sequence[str] | None = None,
        affine: Mapping[str, tuple[float, float]] | None = None, start: float | None = None, end: float | None = None,
    ) -> DataFrame:
        """The finite sample nearest to each place of (recording_id, place, t, value), by
        (dt * t_scale)^2 + (dvalue * value_scale)^2; ties go to the channel named first, then to
        the first by name, then to the earlier sample.

        ``affine`` gives channels whose values are shown as a * value + b.  Repeated places count
        once; those whose t or value isn't finite, or that find no sample, have no row.

        Branch and bound, all places at once: on each level a box can't be nearer than its
        bounds and isn't farther than its own four points, so boxes beyond the best of a
        place's points are left with all below them, and so are boxes that can only be as near
        as an earlier sample of their channel.  ``leaves_read`` tells how many leaves of
        samples a place still had to read."""
        if not all(math.isfinite(s) and s > 0 for s in (t_scale, value_scale)):
            raise RecordingError("InvalidOptions", "scales must be finite and above 0")
        if affine and not all(math.isfinite(x) for pair in affine.values() for x in pair):
            raise RecordingError("InvalidOptions", "a * value + b needs finite a and b")
        low, high = -math.inf if start is None else start, math.inf if end is None else end
        square = lambda c: c * c

        def shown(v: Column) -> Column:
            out = v
            for name, (a, b) in (affine or {}).items():
                out = F.when(F.col("channel") == name, v * a + b).otherwise(out)
            return out

        def distance(t: Column, v: Column) -> Column:
            return square((t - F.col("at_t")) * t_scale) + square((v - F.col("at_value")) * value_scale)

        def point(name: str) -> Column:
            t, v = F.col(f"{name}.t"), shown(F.col(f"{name}.value"))
            return F.when((t >= low) & (t <= high) & finite(v), distance(t, v))

        def apart(at: str, a: Column, b: Column) -> Column:
            return F.greatest(a - F.col(at), F.col(at) - b, F.lit(0.0))

        a, b = shown(F.col("low.value")), shown(F.col("high.value"))
        across = F.when(finite(a) & finite(b), apart("at_value", F.least(a, b), F.greatest(a, b))).otherwise(0.0)
        along = apart("at_t", F.greatest(F.col("t_low"), F.lit(low)), F.least(F.col("t_high"), F.lit(high)))
        bound = square(along * t_scale) + square(across * value_scale)
        reach = (F.col("finite_count") > 0) & (F.col("t_low") <= high) & (F.col("t_high") >= low)
        asked = ["place_recording", "place", "at_t", "at_value"]
        scratch = Scratch(self.spark)
        where = places.where(finite(F.col("t")) & finite(F.col("value")))
        where = where.select(F.col("recording_id").alias("place_recording"), "place", F.col("t").cast("double").alias("at_t"), F.col("value").cast("double").alias("at_value")).distinct()

        boxes = self.boxes(self.top)
        if channels is not None:
            boxes = boxes.where(F.col("channel").isin(*channels))
        met = where.join(boxes, F.col("place_recording").eqNullSafe(F.col("recording_id")))
        for level in range(self.top, -1, -1):
            points = [(F.col(f"{name}.sample"), point(name)) for name in ("first", "last", "low", "high")]
            scored = met.where(reach).withColumn("point", F.least(*(d for _, d in points)))
            at = F.least(*(F.when(d == F.col("point"), n) for n, d in points))
            scored = scratch.save(scored.select(*asked, *SERIES, "bucket", bound.alias("bound"), "point", at.alias("at")))
            best = scored.groupBy(*[F.col(c).alias(f"b_{c}") for c in asked]).agg(F.min("point").alias("best"))
            same = _pairs([(c, f"b_{c}") for c in asked])
            near = scored.join(best, same).where(F.col("best").isNull() | (F.col("bound") <= F.col("best") * (1 + 1e-12)))
            near = scratch.save(near.select(*asked, *SERIES, "bucket", "bound", "best", F.when(F.col("point") == F.col("best"), F.col("at")).alias("at")))
            # Of a channel's samples that are as near as the best point, only the first counts: boxes that
            # can only be as near and begin after it go, however many copies a point has.
            tie = near.where("at IS NOT NULL").groupBy(*[F.col(c).alias(f"b_{c}") for c in (*asked, *SERIES)]).agg(F.min("at").alias("tie"))
            begins = F.col("bucket") * (self.leaf * self.fan**level)
            kept = near.join(tie, _pairs([(c, f"b_{c}") for c in (*asked, *SERIES)]), "left")
            kept = kept.where(F.col("tie").isNull() | (F.col("bound") < F.col("best")) | (begins <= F.col("tie")))
            kept = scratch.save(kept.select(*asked, *SERIES, "bucket", "best", "tie"))
            scratch.free(scored, near)
            wanted, few = self._known(kept, scratch)
            open_ = kept.withColumnsRenamed({c: f"k_{c}" for c in (*SERIES, "bucket")})
            if few is None:  # places times boxes: a table that grows with both isn't broadcast
                open_ = open_.hint("merge")
            if level:
                below, list_below = self._children(wanted, few)
                lower = self._at(self.boxes(level - 1), below, list_below)
                lower = lower.withColumn("above", F.floor(F.col("bucket") / self.fan))
                met = open_.join(lower, _pairs([(f"k_{c}", c) for c in SERIES]) & (F.col("k_bucket") == F.col("above")))
        rows = self._at(self.samples(), wanted, few).where(finite(F.col("t")) & F.col("t").between(low, high) & finite(F.col("value")))
        rows = rows.withColumn("value", shown(F.col("value"))).where(finite(F.col("value")))
        met = open_.join(rows, _pairs([(f"k_{c}", c) for c in SERIES]) & (F.col("k_bucket") == F.col("bucket")))
        met = met.withColumn("distance", distance(F.col("t"), F.col("value")))
        # The least struct of a place is found by sorting, so only samples that may be it are sorted: not
        # all of each leaf.
        first = F.col("tie").isNull() | (F.col("sample") <= F.col("tie"))
        met = met.where(F.col("best").isNull() | (F.col("distance") < F.col("best")) | (F.col("distance") == F.col("best")) & first)
        rank = F.array_position(F.array(*map(F.lit, channels)), F.col("channel")) if channels is not None else F.lit(0)
        order = F.struct("distance", rank.cast("long").alias("rank"), "channel", "sample", "t", "value")
        near = met.groupBy(*asked).agg(F.min(order).alias("n"))
        read = kept.groupBy(*asked).agg(F.count("*").alias("leaves_read")).withColumnsRenamed({c: f"b_{c}" for c in asked})
        near = near.join(read, same)
        return near.select(F.col("place_recording").alias("recording_id"), "place", "n.channel", "n.sample", "n.t", "n.value", "n.rank", "n.distance", "leaves_read")


def _pixel(t: str, start: float, end: float, pixels: int) -> Column:
    return F.least(F.floor((F.col(t) - start) / (end - start) * pixels), F.lit(pixels - 1))
