"""The time axis: monotonic times, cadence, gaps, stitching."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavemill.clock import FIRST_STEP, MonotonicClock, Runs
from wavemill.operators.blocks import BLOCK, neighbours, running_sum
from wavemill.recording import SERIES, RecordingError, finite
from wavemill.scratch import settle

GAP_FACTOR = 1.5  # an interval beyond this many cadences is a gap


def monotonic(long: DataFrame) -> DataFrame:
    """Replaces t by strictly increasing times, in closed form.

    Where t stands still or runs back, all that follows moves on so that the row comes one
    last positive step after its predecessor.  Times that aren't finite become null and leave
    no trace.  Exact up to rounding unless equal times follow a backward jump;
    ``monotonic_exact`` repeats the recurrence digit by digit."""
    if not long.where(~finite(F.col("t"))).limit(1).count():
        return _monotonic(long, "sample").select(*long.columns)
    # Only finite times count: they are numbered by themselves, the others join again at the end.
    rows = running_sum(long, {"__place": finite(F.col("t")).cast("long")})
    there = _monotonic(rows.where(finite(F.col("t"))), "__place").select(*long.columns)
    return there.unionByName(long.where(~finite(F.col("t"))).withColumn("t", F.lit(None).cast("double")))


def _monotonic(long: DataFrame, order: str) -> DataFrame:
    rows = neighbours(long, {"__before": ("t", -1)}, order=order).withColumn("__d", F.col("t") - F.col("__before"))
    # The last positive step before a row: within its block, else of the blocks before.
    rows = rows.withColumn("__block", F.floor(F.col(order) / BLOCK)).withColumn("__up", F.when(F.col("__d") > 0, F.col("__d")))
    held = rows.where("__up IS NOT NULL").groupBy(*SERIES, "__block").agg(F.max(F.struct(order, "__up")).alias("__l"))
    blocks = rows.select(*SERIES, "__block").distinct().join(held, [*SERIES, "__block"], "left")
    past = Window.partitionBy(*SERIES).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*SERIES, "__block", F.last("__l.__up", ignorenulls=True).over(past).alias("__carried"))
    ahead = Window.partitionBy(*SERIES, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(settle(blocks), [*SERIES, "__block"]).withColumn("__step", F.coalesce(F.last("__up", ignorenulls=True).over(ahead), "__carried", F.lit(FIRST_STEP)))
    shift = F.when(F.col("__d") <= 0, F.col("__step") - F.col("__d")).otherwise(0.0)
    rows = running_sum(rows.drop("__block"), {"__shift": shift}, order=order)
    return rows.withColumn("t", F.col("t") + F.col("__shift"))


def advance(times: np.ndarray, clock: MonotonicClock | None = None) -> np.ndarray:
    """The recurrence itself; times that aren't finite become NaN and leave no trace."""
    clock = clock or MonotonicClock()
    return np.array([clock.place(now) if np.isfinite(now) else np.nan for now in times.tolist()], float)


RUN = "recording_id string, channel string, block long, row long, first double, last double, least double, step double, rows long"
CARRY = "recording_id string, channel string, block long, source double, placed double, offset double, step double, sure boolean"


def monotonic_exact(long: DataFrame, block: int = BLOCK) -> DataFrame:
    """As ``monotonic``, digit by digit: the literal recurrence, a block of samples a task.

    Blocks give their runs of increasing times, along which the recurrence only adds an offset; a
    pass over these rows, in order, gives the state before each block, from which blocks are
    done for good.  Channels with runs whose steps are lost to rounding go through one task each."""
    rows = long.withColumn("__block", F.floor(F.col("sample") / block))
    runs = rows.groupBy(*SERIES, "__block").applyInPandas(_block_runs, RUN)
    carry = settle(runs.repartition(*SERIES).sortWithinPartitions(*SERIES, "block", "row").mapInArrow(_fold_runs, CARRY))
    fine = carry.groupBy(*SERIES).agg(F.bool_and("sure").alias("sure"))
    unsure = settle(fine.where("NOT sure").select(*SERIES))
    carry = carry.join(unsure, list(SERIES), "left_anti").select(*SERIES, F.col("block").alias("__block"), *(F.col(c).alias(f"__{c}") for c in ("source", "placed", "offset", "step")))

    columns = long.columns

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, first = group.sort_values("sample"), group.iloc[0]
        clock = MonotonicClock()
        if not pd.isna(first["__offset"]):
            clock = MonotonicClock(*(None if pd.isna(first[c]) else float(first[c]) for c in ("__source", "__placed")), float(first["__offset"]), float(first["__step"]))
        group["t"] = advance(group["t"].to_numpy(float), clock)
        return group[columns]

    # Blocks without finite times have no state and need none.
    out = rows.join(unsure, list(SERIES), "left_anti").join(carry, [*SERIES, "__block"], "left").groupBy(*SERIES, "__block").applyInPandas(run, long.schema)
    if unsure.limit(1).count():
        whole = long.join(unsure, list(SERIES), "left_semi").groupBy(*SERIES)
        out = out.unionByName(whole.applyInPandas(lambda g: (g := g.sort_values("sample")).assign(t=advance(g["t"].to_numpy(float))), long.schema))
    return out


def _block_runs(group: pd.DataFrame) -> pd.DataFrame:
    group, runs = group.sort_values("sample"), Runs()
    times = group["t"].to_numpy(float)
    for t in times[np.isfinite(times)].tolist():
        runs.note(t)
    out = pd.DataFrame([*runs], columns=["first", "last", "least", "step", "row"])
    out["rows"] = np.diff(np.r_[out["row"].to_numpy(np.int64), runs.rows + 1]) if len(out) else np.zeros(0, np.int64)
    return out.assign(**{c: group[c].iloc[0] for c in SERIES}, block=group["__block"].iloc[0])[["recording_id", "channel", "block", "row", "first", "last", "least", "step", "rows"]]


def _fold_runs(batches):
    """Runs come in order; gives the state before each block, and whether all runs up to the next
    block are wider than rounding."""
    now = key = clock = None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            here = (r["recording_id"], r["channel"])
            if here != key:
                key, clock, now = here, MonotonicClock(), None
            if r["block"] != now:
                now = r["block"]
                out.append([*key, now, clock.source, clock.placed, clock.offset, clock.step, True])
            if not clock.begin_run(r["first"], r["last"], r["least"]):
                out.append([*key, now, None, None, None, None, False])
            if r["rows"] > 1:
                clock.end_run(r["last"], r["step"])
        if out:
            kinds = [pa.string(), pa.string(), pa.int64(), *[pa.float64()] * 4, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in CARRY.split(", ")])


def intervals(long: DataFrame) -> DataFrame:
    """Adds t_before and dt, the time since the sample before."""
    return neighbours(long, {"t_before": ("t", -1)}).withColumn("dt", F.col("t") - F.col("t_before"))


SELECT = 1 << 18  # values that one task sorts to select among them
PARTS = 4096


def select_places(values: DataFrame, targets: DataFrame) -> DataFrame:
    """(keys, which, at): the value that has so many before it in the order of a channel's values.

    ``values`` has (keys, x); ``targets`` (keys, which, place, lo, hi, n, before): the place lies among
    n values within [lo, hi], ``before`` values are less than these.  Ranges with more than SELECT
    values are cut into PARTS, whose counts tell where the place lies, until the rest can be sorted."""
    found = targets
    while found.where((F.col("lo") < F.col("hi")) & (F.col("n") > SELECT)).limit(1).count():
        wide = (F.col("lo") < F.col("hi")) & (F.col("n") > SELECT)
        rows = values.join(found.where(wide), list(SERIES)).where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        part = F.least(F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * PARTS), F.lit(PARTS - 1))
        keys = [*SERIES, "which", "place"]
        parts = rows.groupBy(*keys, "before", part.alias("part")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = parts.withColumn("before", F.col("before") + below).where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("n")))
        found = settle(found.where(~wide).unionByName(parts.drop("part")))
    known = found.where("lo = hi").select(*SERIES, "which", F.col("lo").alias("at"))
    rows = values.join(found.where("lo < hi"), list(SERIES)).where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
    nth = F.row_number().over(Window.partitionBy(*SERIES, "which", "place").orderBy("x"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") == F.col("place") - F.col("before") + 1)
    return known.unionByName(rows.select(*SERIES, "which", F.col("x").alias("at")))


def cadence(long: DataFrame) -> DataFrame:
    """Typical sample spacing of each channel: (keys, cadence, n_intervals), from the intervals
    that are finite and positive; a channel without any has no row.

    In the order of their sizes, intervals are cut where one is more than 4 times its predecessor; or
    already where one is more than 1.5 times its predecessor, if every interval is within
    5 % of a whole multiple of the median of those before the cut.  The lower part keeps two
    intervals at least, and its median is the cadence.

    Nothing is sorted as a whole: intervals are counted in ranges of a twentieth of the logarithm, of which a
    channel has a few thousand at most.  A cut lies between two of these, and is found
    from their bounds; medians are selected within theirs (``select_places``)."""
    d = settle(intervals(long).where(finite(F.col("dt")) & (F.col("dt") > 0)).select(*SERIES, F.col("dt").alias("x")))
    held = d.groupBy(*SERIES, F.floor(F.log("x") * 20).alias("range")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    w = Window.partitionBy(*SERIES).orderBy("range")
    held = settle(held.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("r", F.col("lo") / F.lag("hi").over(w)))
    first = lambda ratio: F.min(F.when((F.col("before") >= 2) & (F.col("r") > ratio), F.col("before")))
    cuts = held.groupBy(*SERIES).agg(F.sum("n").alias("total"), first(4).alias("cut4"), first(GAP_FACTOR).alias("cut15"))
    cuts = cuts.withColumn("late", F.coalesce("cut4", "total")).withColumn("early", F.when(F.col("cut15") < F.coalesce("cut4", F.col("total") + 1), F.col("cut15")))
    cuts = cuts.select(*SERIES, "total", "late", "early")
    # The two middle places of the intervals before each cut.
    sides = F.array(*(F.struct(F.lit(name).alias("which"), F.floor((F.col(name) + odd) / 2).alias("place")) for name in ("late", "early") for odd in (-1, 0)))
    places = cuts.select(*SERIES, F.explode(sides).alias("p")).select(*SERIES, "p.*").where("place IS NOT NULL")
    targets = places.join(held.drop("range", "r"), list(SERIES)).where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("n")))
    medians = select_places(d, targets.distinct()).groupBy(*SERIES).agg(
        *((0.5 * F.min(F.when(F.col("which") == name, F.col("at"))) + 0.5 * F.max(F.when(F.col("which") == name, F.col("at")))).alias(f"at_{name}") for name in ("late", "early"))
    )
    out = cuts.join(medians, list(SERIES))
    if not cuts.where("early IS NOT NULL").limit(1).count():
        return out.select(*SERIES, F.col("at_late").alias("cadence"), F.col("total").alias("n_intervals"))
    out, ratio = settle(out), F.col("x") / F.col("at_early")
    fits = d.join(out.where("early IS NOT NULL").select(*SERIES, "at_early"), list(SERIES)).groupBy(*SERIES).agg(F.bool_and((ratio >= 0.95) & (F.abs(ratio - F.round(ratio)) <= 0.05)).alias("fits"))
    return out.join(fits, list(SERIES), "left").select(*SERIES, F.when(F.col("fits"), F.col("at_early")).otherwise(F.col("at_late")).alias("cadence"), F.col("total").alias("n_intervals"))


def timeline_report(long: DataFrame) -> DataFrame:
    """Samples, bounds, cadence, whether there are gaps, and a status: OK, TooShort (under 4
    samples) or InvalidTime (not finite and strictly increasing)."""
    rows = intervals(long).join(settle(cadence(long)), list(SERIES), "left")
    bad = ~finite(F.col("t")) | (F.col("dt") <= 0)
    got = rows.groupBy(*SERIES).agg(
        F.count("*").alias("n"),
        F.min("t").alias("t_start"),
        F.max("t").alias("t_end"),
        F.max("cadence").alias("cadence"),
        F.max(F.coalesce(F.col("dt") > GAP_FACTOR * F.col("cadence"), F.lit(False))).alias("has_gaps"),
        F.max(F.coalesce(bad, ~finite(F.col("t")))).alias("bad"),
    )
    status = F.when(F.col("n") < 4, "TooShort").when(F.col("bad"), "InvalidTime").otherwise("OK")
    return got.withColumn("status", status).drop("bad")


def gaps(long: DataFrame, threshold: float | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
    """(keys, sample, left, right, duration, missing) for each pair of neighbours further apart
    than the threshold (default: 1.5 cadences) that meets [start, end].

    ``missing`` estimates the samples lost: the duration in cadences, rounded half away from
    zero, less one."""
    rows = intervals(long).join(settle(cadence(long)), list(SERIES))
    limit = F.lit(threshold) if threshold is not None else GAP_FACTOR * F.col("cadence")
    rows = rows.where(F.col("dt") > limit)
    if start is not None:
        rows = rows.where(F.col("t") >= start)
    if end is not None:
        rows = rows.where(F.col("t_before") <= end)
    missing = F.greatest(F.lit(0), F.round(F.col("dt") / F.col("cadence")).cast("long") - 1)
    return rows.select(*SERIES, "sample", F.col("t_before").alias("left"), F.col("t").alias("right"), F.col("dt").alias("duration"), missing.alias("missing"))


def step_for_missing(duration: float, missing: int) -> float:
    """The cadence at which a gap of this duration has lost so many samples."""
    return duration / (missing + 1)


def segments(long: DataFrame) -> DataFrame:
    """Runs of samples between gaps: (keys, segment, t_start, t_end, n, display_start).

    Laid end to end, a segment starts one cadence after the end of the one before."""
    rows = _with_segment(long)
    s = rows.groupBy(*SERIES, "segment").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n"), F.max("cadence").alias("cadence"))
    w = Window.partitionBy(*SERIES).orderBy("segment")
    before = F.coalesce(F.sum(F.col("t_end") - F.col("t_start") + F.col("cadence")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return s.withColumn("display_start", F.first("t_start").over(w) + before)


def _with_segment(long: DataFrame) -> DataFrame:
    rows = intervals(long).join(settle(cadence(long)), list(SERIES), "left")
    return running_sum(rows, {"segment": F.coalesce(F.col("dt") > GAP_FACTOR * F.col("cadence"), F.lit(False)).cast("long")})


def stitched(long: DataFrame) -> DataFrame:
    """Adds segment and display, the time on an axis without gaps."""
    place = settle(segments(long).select(*SERIES, "segment", F.col("t_start").alias("__t0"), "display_start"))
    rows = _with_segment(long).join(place, [*SERIES, "segment"])
    return rows.withColumn("display", F.col("display_start") + F.col("t") - F.col("__t0")).select(*long.columns, "segment", "display")


def display_to_time(places: DataFrame, segs: DataFrame) -> DataFrame:
    """Times of (keys, display): within a segment its own axis; between two, in proportion.

    The axis of a channel is cut into as many equal parts as it has segments; a place meets
    only the segments that reach into its part."""
    w, whole = Window.partitionBy(*SERIES).orderBy("segment"), Window.partitionBy(*SERIES)
    s = segs.withColumn("display_end", F.col("display_start") + F.col("t_end") - F.col("t_start")).withColumn("t_next", F.lead("t_start").over(w)).withColumn("display_next", F.lead("display_start").over(w))
    s = s.withColumn("__n", F.count("*").over(whole)).withColumn("__from", F.min("display_start").over(whole))
    width = F.greatest(F.max("display_end").over(whole) - F.col("__from"), F.lit(1e-300)) / F.col("__n")
    first = F.col("display_start") == F.col("__from")
    s = s.withColumn("__width", width).withColumn("lo", F.when(first, float("-inf")).otherwise(F.col("display_start"))).withColumn("hi", F.coalesce("display_next", F.lit(float("inf"))))
    s = settle(s)

    def part(x):
        return F.least(F.greatest(F.floor(F.least(F.greatest((x - F.col("__from")) / F.col("__width"), F.lit(0.0)), F.col("__n"))), F.lit(0)), F.col("__n") - 1)

    axis = s.groupBy(*SERIES).agg(F.first("__n").alias("__n"), F.first("__from").alias("__from"), F.first("__width").alias("__width"))
    dealt = places.join(axis, list(SERIES)).withColumn("__part", part(F.col("display"))).drop("__n", "__from", "__width")
    reach = s.withColumn("__part", F.explode(F.sequence(part(F.col("lo")), part(F.col("hi"))))).drop("__n", "__from", "__width", *(set(places.columns) & set(s.columns) - set(SERIES)))
    rows = dealt.join(reach, [*SERIES, "__part"]).where((F.col("display") >= F.col("lo")) & (F.col("display") < F.col("hi")))
    inside = F.least(F.greatest(F.col("display") - F.col("display_start"), F.lit(0.0)), F.col("t_end") - F.col("t_start"))
    between = F.col("t_end") + (F.col("display") - F.col("display_end")) / (F.col("display_next") - F.col("display_end")) * (F.col("t_next") - F.col("t_end"))
    t = F.when((F.col("display") > F.col("display_end")) & F.col("t_next").isNotNull(), between).otherwise(F.col("t_start") + inside)
    return rows.select(*places.columns, t.alias("t"))


def display_step(long: DataFrame, limit: int = 4096) -> DataFrame:
    """Median of about ``limit`` intervals taken at an even stride: (keys, step).

    A description of the axis for display, not an analysis: it looks at few intervals by design."""
    n = long.groupBy(*SERIES).agg(F.count("*").alias("n")).withColumn("stride", F.greatest(F.lit(1), F.floor(F.col("n") / limit)))
    rows = intervals(long).join(settle(n), list(SERIES)).where((F.col("sample") % F.col("stride") == 0) & (F.col("dt") > 0))
    return rows.groupBy(*SERIES).agg(F.median("dt").alias("step"))


def blended_step(local: float, whole: float, n_local: int) -> float:
    """The step of a view: the whole recording's if the view has few samples or a far larger
    step, else the view's own, up to four times the whole's."""
    if n_local < 8 or local > 8 * whole:
        return whole
    return min(local, 4 * whole)


def duplicate_time_channels(long: DataFrame, raw_t: str = "t") -> DataFrame:
    """(recording_id, channel) of channels that repeat the time axis wherever both are present."""
    same = F.abs(F.col("value") - F.col(raw_t)) <= 1e-12 + 1e-9 * F.abs(F.col(raw_t))
    both = F.col("value").isNotNull() & finite(F.col(raw_t))
    return long.where(both).groupBy(*SERIES).agg(F.bool_and(same).alias("all")).where("all").select(*SERIES)


def drop_duplicate_time_channels(long: DataFrame, raw_t: str = "t") -> DataFrame:
    return long.join(duplicate_time_channels(long, raw_t), list(SERIES), "left_anti")


def require_timeline(report: DataFrame) -> None:
    """Raises the first reason why an analysis of these channels can't be made."""
    row = report.where("status <> 'OK'").select("channel", "status").orderBy("channel").first()
    if row:
        raise RecordingError(row["status"], f"channel {row['channel']}")

