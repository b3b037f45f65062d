"""Amplitude spectra and peaks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavemill.operators.blocks import neighbours, running_sum
from wavemill.operators.long_spectrum import SPECTRUM, long_spectrum
from wavemill.operators.timeline import GAP_FACTOR, cadence, intervals
from wavemill.recording import SERIES, RecordingError, finite
from wavemill.scratch import settle
from wavemill.sources.numeric import parse_cell

LIMIT = 1 << 22  # samples that one task transforms
TOLERANCE = 1e-6  # of the spacing, by which samples may lie off the even grid and stay as they are


def compressed_axis(long: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds offset, the time since the first sample with every gap shortened to one cadence,
    and the facts of the channel: n, grid (even spacing), resampled, gaps_ignored."""
    rows = intervals(long).join(settle(cadence(long)), list(SERIES))
    gap = F.coalesce(F.col("dt") > GAP_FACTOR * F.col("cadence"), F.lit(False))
    step = F.when(gap, F.col("cadence")).otherwise(F.coalesce("dt", F.lit(0.0)))
    # Multiples of 2**-20 add up exactly and leave sums of small rests, so rounding doesn't grow along a channel.
    rows = rows.withColumn("__step", step).withColumn("__coarse", F.rint(F.col("__step") * 2.0**20) * 2.0**-20).withColumn("__fine", F.col("__step") - F.col("__coarse"))
    bad = F.col("value").isNotNull() & ~finite(F.col("value"))
    facts = rows.groupBy(*SERIES).agg(
        F.count("*").alias("n"), (F.sum("__coarse") + F.sum("__fine")).alias("span"), F.max(gap).alias("gaps_ignored"), F.coalesce(F.max(F.col("dt") <= 0), F.lit(False)).alias("backward"),
        F.avg("value").alias("mean"), F.count("value").alias("got"), F.max(bad).alias("infinite"),
    )
    facts = facts.withColumn("grid", F.col("span") / (F.col("n") - 1))
    rows = running_sum(rows, {"__a": F.col("__coarse"), "__b": F.col("__fine")}).withColumn("offset", F.col("__a") + F.col("__b")).join(settle(facts), list(SERIES))
    inner = (F.col("sample") > 0) & (F.col("sample") < F.col("n") - 1)
    # Rounding of extended precision, or the tolerance, whichever is more.
    slack = F.greatest(F.col("span") * 2.0**-62, tolerance * F.col("grid"))
    off = inner & (F.abs(F.col("offset") - F.col("sample") * F.col("grid")) > slack)
    uneven = settle(rows.groupBy(*SERIES).agg(F.max(off).alias("resampled")))
    return rows.join(uneven, list(SERIES)).drop("t_before", "dt", "cadence", "span", "__step", "__coarse", "__fine", "__a", "__b")


def clocked(long: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(keys, n, grid, mean, usable, clocked) of each channel by two passes of sums, without moving
    its rows: clocked are those whose times all lie on one even grid, by half the tolerance
    of ``compressed_axis``, which then would find neither gaps nor uneven samples."""
    bad = F.col("value").isNotNull() & ~finite(F.col("value"))
    facts = long.groupBy(*SERIES).agg(
        F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("sample").alias("last"), F.bool_and(finite(F.col("t"))).alias("fine"),
        F.avg("value").alias("mean"), F.count("value").alias("got"), F.max(bad).alias("infinite"),
    )
    facts = settle(facts.withColumn("grid", F.try_divide(F.col("t1") - F.col("t0"), F.col("n") - 1)))
    off = long.join(facts.select(*SERIES, "t0", "grid"), list(SERIES)).groupBy(*SERIES).agg(F.max(F.abs(F.col("t") - F.col("t0") - F.col("sample") * F.col("grid"))).alias("off"))
    even = F.col("fine") & (F.col("last") == F.col("n") - 1) & (F.col("grid") > 0) & (F.col("off") <= 0.5 * tolerance * F.col("grid"))
    usable = (F.col("got") >= 4) & ~F.col("infinite") & F.col("fine")
    return facts.join(off, list(SERIES)).select(*SERIES, "n", "grid", "mean", usable.alias("usable"), F.coalesce(even, F.lit(False)).alias("clocked"))


def even_samples(long: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Values on the even grid: missing ones become the channel's mean, uneven channels are
    interpolated linearly at k * grid, the first and the last sample staying.  Channels are uneven if
    a sample lies further off the grid than the tolerance, a part of the spacing; with 0, if any lies off.

    Channels with fewer than 4 finite samples or with an infinite one, or whose time is missing
    somewhere, stands still or runs back, are left out (``spectrum_status`` names the reason).
    Clocked channels are taken as they are."""
    return _even(long, settle(clocked(long, tolerance).where("usable")), tolerance)


def _even(long: DataFrame, facts: DataFrame, tolerance: float) -> DataFrame:
    value = F.coalesce("value", "mean").alias("value")
    out = long.join(facts.where("clocked"), list(SERIES)).select(*SERIES, "sample", value, "n", "grid", F.lit(False).alias("resampled"), F.lit(False).alias("gaps_ignored"))
    others = facts.where("NOT clocked").select(*SERIES)
    if others.limit(1).count():
        out = out.unionByName(_regridded(long.join(others, list(SERIES), "left_semi"), tolerance))
    return out


def spectrum_status(long: DataFrame) -> DataFrame:
    """(keys, n, status) of each channel: OK; TooShort, if it has fewer than 4 samples with a value;
    InvalidTime, if its times aren't all finite and strictly increasing; InfiniteValues."""
    rows = intervals(long)
    wrong = ~finite(F.col("t")) | F.coalesce(F.col("dt") <= 0, F.lit(False))
    infinite = F.col("value").isNotNull() & ~finite(F.col("value"))
    facts = rows.groupBy(*SERIES).agg(F.count("*").alias("n"), F.count("value").alias("got"), F.max(wrong).alias("wrong"), F.max(infinite).alias("infinite"))
    status = F.when(F.col("got") < 4, "TooShort").when(F.col("wrong"), "InvalidTime").when(F.col("infinite"), "InfiniteValues").otherwise("OK")
    return facts.select(*SERIES, "n", status.alias("status"))


def require_spectrum(long: DataFrame) -> DataFrame:
    """The spectra of the channels that have one; an error if there is none."""
    status = settle(spectrum_status(long))
    if not status.where("status = 'OK'").limit(1).count():
        row = status.orderBy(*SERIES).first()
        raise RecordingError(row["status"] if row else "TooShort", f"no spectrum{' of ' + row['channel'] if row else ''}")
    return amplitude_spectrum(long)


def _regridded(long: DataFrame, tolerance: float) -> DataFrame:
    rows = compressed_axis(long, tolerance).where("got >= 4 AND NOT infinite AND NOT backward")
    rows = rows.withColumn("value", F.coalesce("value", "mean")).select(*SERIES, "sample", "offset", "value", "n", "grid", "resampled", "gaps_ignored")
    rows = neighbours(rows, {"__o": ("offset", 1), "__v": ("value", 1)})
    last = F.col("sample") == F.col("n") - 1
    # Grid places k with offset <= k * grid < next offset lie between this sample and the next.
    lo = F.when(F.col("sample") == 0, 0).otherwise(F.greatest(F.ceil(F.col("offset") / F.col("grid")), F.lit(1)))
    hi = F.least(F.ceil(F.col("__o") / F.col("grid")) - 1, F.col("n") - 2)
    places = F.when(last, F.array(F.col("n") - 1)).when(hi >= lo, F.sequence(lo.cast("long"), hi.cast("long")))
    places = F.when(F.col("resampled"), F.filter(places, lambda k: k >= 0)).otherwise(F.array(F.col("sample")))
    rows = rows.withColumn("k", F.explode(places))
    part = (F.col("k") * F.col("grid") - F.col("offset")) / (F.col("__o") - F.col("offset"))
    value = F.when(~F.col("resampled") | last | (F.col("k") == 0), F.col("value")).otherwise(F.col("value") + part * (F.col("__v") - F.col("value")))
    return rows.select(*SERIES, F.col("k").alias("sample"), value.alias("value"), "n", "grid", "resampled", "gaps_ignored")


def _amplitudes(x: np.ndarray) -> np.ndarray:
    n = len(x)
    amp = np.abs(np.fft.rfft(x - x.mean())) * (2.0 / n)
    amp[0] /= 2
    if n % 2 == 0:
        amp[-1] /= 2
    return amp


def amplitude_spectrum(long: DataFrame, max_samples: int = 0, limit: int = LIMIT, tolerance: float = TOLERANCE) -> DataFrame:
    """One-sided amplitudes of the mean-free signal: (keys, bin, freq, amp), 2/N in between,
    1/N at zero and, for even N, at the highest bin.

    ``max_samples`` takes the first so many samples (0: all; else 4 at least).  Channels of more
    than ``limit`` samples are transformed by many tasks of about that size each; where that is
    too small for a row of the transform, tasks grow with the root of the length.  ``tolerance`` is
    that of ``even_samples``."""
    if max_samples:
        if max_samples < 4:
            raise RecordingError("TooShort", "at least 4 samples are needed")
        long = long.where(F.col("sample") < max_samples)
    facts = settle(clocked(long, tolerance).where("usable"))
    lengths = facts.where(F.col("n") > limit).select("n").distinct()
    if not lengths.limit(1).count():
        return _by_channel(_even(long, facts, tolerance))
    short, far = (facts.where(F.col("n") <= limit), facts.where(F.col("n") > limit))
    even = _even(long.join(far.select(*SERIES), list(SERIES), "left_semi"), far, tolerance).join(far.select(*SERIES, "mean"), list(SERIES))
    out = long_spectrum(even, lengths, limit)
    if not short.limit(1).count():
        return out
    return out.unionByName(_by_channel(_even(long.join(short.select(*SERIES), list(SERIES), "left_semi"), short, tolerance)))


def _by_channel(even: DataFrame) -> DataFrame:
    even = even.select(*SERIES, "sample", "value", "grid")
    return even.repartition(*SERIES).sortWithinPartitions(*SERIES, "sample").mapInArrow(_transform, SPECTRUM)


def _transform(batches):
    """Rows come sorted by channel and sample; a channel's values are gathered and transformed."""
    now, parts, grid = None, [], 0.0

    def done():
        x = np.concatenate(parts)
        amp = _amplitudes(x)
        k = np.arange(len(amp))
        names = [pa.repeat(pa.scalar(v, pa.string()), len(k)) for v in now]
        return pa.RecordBatch.from_arrays([*names, pa.array(k), pa.array(k / (len(x) * grid)), pa.array(amp)], names=["recording_id", "channel", "bin", "freq", "amp"])

    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(c).dictionary_encode().indices.to_numpy() for c in SERIES]
        starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], axis=0)])).tolist()
        values, grids = batch.column("value").to_numpy(zero_copy_only=False), batch.column("grid")
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(batch.column(c)[lo].as_py() for c in SERIES)
            if key != now:
                if parts:
                    yield done()
                now, parts, grid = key, [], grids[lo].as_py()
            parts.append(values[lo:hi])
    if parts:
        yield done()


def discrete_transform(even: DataFrame, harmonics: int | None = None) -> DataFrame:
    """The same amplitudes by the defining sums in SQL, bin by bin, for short signals (or only
    the first ``harmonics`` bins); the phase is reduced as an integer first."""
    rows = even.withColumn("c", F.col("value") - F.avg("value").over(Window.partitionBy(*SERIES)))
    top = F.floor(F.col("n") / 2) if harmonics is None else F.least(F.floor(F.col("n") / 2), F.lit(harmonics))
    rows = rows.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), top)))
    angle = 2 * np.pi * ((F.col("bin") * F.col("sample")) % F.col("n")) / F.col("n")
    sums = rows.groupBy(*SERIES, "bin", "n", "grid").agg(F.sum(F.col("c") * F.cos(angle)).alias("re"), F.sum(F.col("c") * F.sin(angle)).alias("im"))
    edge = (F.col("bin") == 0) | (2 * F.col("bin") == F.col("n"))
    amp = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) * F.when(edge, 1.0).otherwise(2.0) / F.col("n")
    return sums.select(*SERIES, "bin", (F.col("bin") / (F.col("n") * F.col("grid"))).alias("freq"), amp.alias("amp"))


def bin_range(spectrum: DataFrame, lo: float, hi: float) -> DataFrame:
    """Bins with lo <= freq <= hi."""
    return spectrum.where((F.col("freq") >= lo) & (F.col("freq") <= hi))


def find_peaks(spectrum: DataFrame, n: int = 5) -> DataFrame:
    """The n highest local maxima of each channel: (keys, rank, bin, freq, amp).

    A bin (not the first) is a peak if it is above its left and not below its right
    neighbour; the last one if it is positive and above its left.  Without peaks the
    highest positive bin but the first counts.  A channel with an amplitude that isn't finite
    has none.  Equal amplitudes rank by frequency."""
    if n < 1:
        raise RecordingError("InvalidOptions", "n must be at least 1")
    rows = neighbours(spectrum, {"__left": ("amp", -1), "__right": ("amp", 1)}, order="bin")
    rows = rows.withColumn("peak", F.coalesce((F.col("bin") >= 1) & (F.col("amp") > F.col("__left")) & F.when(F.col("__right").isNull(), F.col("amp") > 0).otherwise(F.col("amp") >= F.col("__right")), F.lit(False)))
    facts = rows.groupBy(*SERIES).agg(F.bool_and(finite(F.col("amp"))).alias("__fine"), F.max("peak").alias("__any"))
    rows = rows.join(settle(facts), list(SERIES)).where("__fine AND bin >= 1 AND (peak OR NOT __any AND amp > 0)")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("amp"), "freq")))
    return rows.where((F.col("rank") <= n) & (F.col("__any") | (F.col("rank") == 1))).select(*SERIES, "rank", "bin", "freq", "amp")


def display_points(spectrum: DataFrame, lo: float, hi: float, pixels: int) -> DataFrame:
    """At most four bins for each pixel column: first, last, lowest and highest."""
    inside = bin_range(spectrum, lo, hi).withColumn("pixel", F.least(F.floor((F.col("freq") - lo) / (hi - lo) * pixels), F.lit(pixels - 1)))
    point = F.struct("bin", "freq", "amp")
    got = inside.groupBy(*SERIES, "pixel").agg(
        F.min(point).alias("a"),
        F.max(point).alias("b"),
        F.min(F.struct("amp", "bin", "freq")).alias("c"),
        F.max(F.struct(F.col("amp"), (-F.col("bin")).alias("bin"), "freq")).alias("d"),
    )
    four = F.array_sort(F.array_distinct(F.array("a", "b", F.struct("c.bin", "c.freq", "c.amp"), F.struct((-F.col("d.bin")).alias("bin"), "d.freq", "d.amp"))))
    return got.select(*SERIES, "pixel", F.explode(four).alias("p")).select(*SERIES, "pixel", "p.*")


def stored_sampling(comments: list[str]) -> dict[str, float | int | bool]:
    """What a stored spectrum's [fft_sampling] section says of the signal it came from."""
    kinds = {"source_start": float, "source_end": float, "sample_dt": float, "sample_count": int, "resampled": bool, "gaps_ignored": bool}
    out, within = {}, False
    for line in comments:
        if line.startswith("["):
            within = line == "[fft_sampling]"
            continue
        key, _, text = line.partition("=")
        value = parse_cell(text)[0]
        if not within or key not in kinds or value is None or (key == "sample_dt" and value <= 0) or (key == "sample_count" and value < 0):
            continue
        out[key] = value == 1 if kinds[key] is bool else kinds[key](value)
    return out


def import_spectrum(long: DataFrame) -> DataFrame:
    """A stored spectrum (t is the frequency) as it stands; frequencies must be finite, not
    negative and strictly increasing, amplitudes finite and not negative."""
    rows = neighbours(long, {"__before": ("t", -1)})
    wrong = ~finite(F.col("t")) | (F.col("t") < 0) | F.coalesce(F.col("t") <= F.col("__before"), F.lit(False)) | ~finite(F.col("value")) | (F.col("value") < 0)
    if rows.where(wrong).limit(1).count():
        raise RecordingError("FrequencyData", "not a valid stored spectrum")
    return long.select(*SERIES, F.col("sample").alias("bin"), F.col("t").alias("freq"), F.col("value").alias("amp"))
