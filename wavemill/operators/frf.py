"""Frequency response of response channels to reference channels: Welch H1 and direct.

References are averaged sample by sample first.  Segments of L samples overlap by half; a
sample belongs to two of them at most, so segments are gathered in groups of neighbours and
each task returns sums over its group, one row a bin and response, never its segments.
Any number of recordings are analysed at once, each with its own length, cadence and status.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavemill.operators.blocks import running_sum
from wavemill.operators.timeline import GAP_FACTOR, cadence, intervals
from wavemill.recording import SERIES, RecordingError, finite
from wavemill.scratch import Scratch, settle

EPS = float(np.finfo(float).eps)
GROUP = 64  # segments that are transformed in one task
# Texts of the statuses that an analysis can end with.
ERRORS = {
    "None": "", "InvalidChannels": "references and responses must be distinct and not empty", "FrequencyData": "the recording holds a spectrum",
    "TooShort": "too few samples", "InvalidTime": "times must be finite and increase", "MissingValues": "a channel has missing values",
    "InvalidOptions": "segment length must be even and 4 or more, the threshold between 0 and 1", "WeakReference": "the reference has no usable frequency",
    "Overflow": "values are too large", "SourceChanged": "the source has changed",
}


@dataclass(frozen=True)
class FrfOptions:
    estimator: str = "h1"  # or "direct"
    remove_mean: bool = True
    threshold: float = 1e-6
    segment_length: int = 0  # 0: the largest power of two within a quarter of the samples


def auto_length(n: int) -> int:
    """The largest power of two that is at most max(4, n // 4)."""
    return 1 << (max(4, n // 4).bit_length() - 1)


def check_roles(references: Sequence[str], responses: Sequence[str]) -> None:
    if not references or not responses or len({*references, *responses}) != len(references) + len(responses):
        raise RecordingError("InvalidChannels", ERRORS["InvalidChannels"])


def check_options(options: FrfOptions) -> None:
    length = options.segment_length
    if not 0 < options.threshold < 1 or options.estimator not in ("h1", "direct") or options.estimator == "h1" and length and (length < 4 or length % 2):
        raise RecordingError("InvalidOptions", ERRORS["InvalidOptions"])


def plan(n: int, options: FrfOptions) -> tuple[int, int, int]:
    """(L, hop, K) for n samples: segment length, distance, number of whole segments."""
    check_options(options)
    if options.estimator == "direct":
        length = hop = n
    else:
        length = options.segment_length or auto_length(n)
        hop = length // 2
    if n < 4 or length > n:
        raise RecordingError("TooShort", ERRORS["TooShort"])
    return length, hop, (n - length) // hop + 1


def _plan(rows: DataFrame, options: FrfOptions) -> DataFrame:
    """Adds length, hop and segments, as ``plan`` has them, to rows with n."""
    quarter = F.greatest(F.lit(4).cast("long"), F.floor(F.col("n") / 4))
    auto = F.expr("shiftleft(1L, length(bin(quarter)) - 1)")  # the highest power of two within it
    direct = options.estimator == "direct"
    length = F.col("n") if direct else F.lit(options.segment_length).cast("long") if options.segment_length else auto
    rows = rows.withColumn("quarter", quarter).withColumn("length", length).drop("quarter")
    rows = rows.withColumn("hop", F.col("length") if direct else F.floor(F.col("length") / 2))
    return rows.withColumn("segments", F.when(F.col("length") <= F.col("n"), F.floor(F.try_divide(F.col("n") - F.col("length"), F.col("hop"))) + 1))


def averaged(long: DataFrame, references: Sequence[str]) -> DataFrame:
    """(recording_id, sample, x): the references' mean, each divided first so that sums don't overflow."""
    some = long.where(F.col("channel").isin(*references))
    return some.groupBy("recording_id", "sample").agg(F.sum(F.col("value") / len(references)).alias("x"))


def inspect(long: DataFrame, references: Sequence[str], responses: Sequence[str], options: FrfOptions = FrfOptions()) -> DataFrame:
    """One row a recording: recording_id, n, step (cadence), length, hop, segments, peak (greatest
    reference value), good (responses without missing values) and status, ``None`` or the first
    reason against an analysis.

    A reference with a missing or infinite value fails its recording; such a response only itself."""
    check_roles(references, responses)
    check_options(options)
    roles = long.where(F.col("channel").isin(*references, *responses))
    facts = roles.groupBy("recording_id", "channel").agg(F.count("*").alias("c"), F.bool_and(finite(F.col("value"))).alias("fine"))
    is_ref = F.col("channel").isin(*references)
    per = facts.groupBy("recording_id").agg(
        F.sum(is_ref.cast("int")).alias("refs"), F.min(F.when(is_ref, F.col("c"))).alias("n"), F.max(F.when(is_ref, F.col("c"))).alias("n_most"),
        F.bool_and(F.col("fine") | ~is_ref).alias("fine"), F.collect_list(F.when(~is_ref, F.struct("channel", "c", "fine"))).alias("others"),
    )
    alike = F.filter("others", lambda o: (o["c"] == F.col("n")))
    per = per.withColumn("good", F.transform(F.filter("others", lambda o: (o["c"] == F.col("n")) & o["fine"]), lambda o: o["channel"])).withColumn("alike", F.size(alike)).drop("others")
    axis = long.where(F.col("channel") == references[0])
    wrong = intervals(axis).groupBy("recording_id").agg(F.max(~finite(F.col("t")) | F.coalesce(~finite(F.col("dt")) & F.col("t_before").isNotNull(), F.lit(False)) | F.coalesce(F.col("dt") <= 0, F.lit(False))).alias("wrong"))
    step = cadence(axis).select("recording_id", F.col("cadence").alias("step"))
    x = averaged(long, references).groupBy("recording_id").agg(F.max(F.abs("x")).alias("peak"), F.max(~finite(F.col("x"))).alias("over"))
    rows = long.select("recording_id").distinct().join(per, "recording_id", "left").join(wrong, "recording_id", "left").join(step, "recording_id", "left").join(x, "recording_id", "left")
    status = (
        F.when(F.coalesce(F.col("refs") < len(references), F.lit(True)) | (F.col("n") < F.col("n_most")), "InvalidChannels")
        .when(~F.col("fine"), "MissingValues")
        .when(F.col("over"), "Overflow")
        .when(F.col("n") < 4, "TooShort")
        .when(F.coalesce("wrong", F.lit(False)) | ~finite(F.col("step")) | ~finite(F.try_divide(F.lit(0.5), F.col("step"))), "InvalidTime")
        .when(F.col("length") > F.col("n"), "TooShort")
        .when(F.size("good") == 0, F.when(F.col("alike") == 0, "InvalidChannels").otherwise("MissingValues"))
        .otherwise("None")
    )
    return _plan(rows, options).withColumn("status", status).select("recording_id", "n", "step", "length", "hop", "segments", F.coalesce("peak", F.lit(0.0)).alias("peak"), "good", "status")


def frf_status(long: DataFrame, references: Sequence[str], responses: Sequence[str], options: FrfOptions = FrfOptions()) -> DataFrame:
    """(recording_id, channel, status) for each response of each recording: the recording's
    status, or MissingValues where only the response is at fault."""
    rows = inspect(long, references, responses, options).withColumn("channel", F.explode(F.array(*map(F.lit, responses))))
    own = F.when(F.array_contains("good", F.col("channel")), "None").otherwise("MissingValues")
    return rows.select("recording_id", "channel", F.when(F.col("status") != "None", F.col("status")).otherwise(own).alias("status"))


def has_gaps(long: DataFrame) -> bool:
    rows = intervals(long).join(settle(cadence(long)), list(SERIES))
    return rows.where(F.col("dt") > GAP_FACTOR * F.col("cadence")).limit(1).count() > 0


SUMS = "recording_id string, channel string, bin long, sxx double, syy double, sxy_re double, sxy_im double"


def cross_spectra(prepared: DataFrame, remove_mean: bool) -> DataFrame:
    """Sums over all segments: (recording_id, channel, bin, sxx, syy, sxy_re, sxy_im), from
    (recording_id, channel, sample, x, y, length, hop, segments)."""
    # A group's samples: from its first segment's start to its last one's end.
    stride = GROUP * F.col("hop")
    last = F.least(F.floor(F.col("sample") / stride), F.floor((F.col("segments") - 1) / GROUP))
    first = F.greatest(F.ceil((F.col("sample") - (F.col("length") - F.col("hop")) - stride + 1) / stride), F.lit(0))
    rows = prepared.where(F.col("sample") < (F.col("segments") - 1) * F.col("hop") + F.col("length"))
    rows = rows.withColumn("grp", F.explode(F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))))

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        length, hop, segments = (int(pdf[c].iloc[0]) for c in ("length", "hop", "segments"))
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
        begin, x, y = key[2] * GROUP * hop, pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        count = min(GROUP, segments - key[2] * GROUP)
        at = np.arange(count)[:, None] * hop + np.arange(length) + (begin - int(pdf["sample"].iloc[0]))
        sxx = syy = sxy = 0.0
        for part in np.array_split(at, max(1, count * length >> 20)):
            a, b = x[part], y[part]
            if remove_mean:
                a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
            fa, fb = np.fft.rfft(a * window), np.fft.rfft(b * window)
            sxx = sxx + (np.abs(fa) ** 2).sum(0)
            syy = syy + (np.abs(fb) ** 2).sum(0)
            sxy = sxy + (np.conj(fa) * fb).sum(0)
        return pd.DataFrame({"recording_id": key[0], "channel": key[1], "bin": np.arange(len(sxx)), "sxx": sxx, "syy": syy, "sxy_re": sxy.real, "sxy_im": sxy.imag})

    parts = rows.groupBy(*SERIES, "grp").applyInPandas(sums, SUMS)
    return parts.groupBy(*SERIES, "bin").agg(*(F.sum(c).alias(c) for c in ("sxx", "syy", "sxy_re", "sxy_im")))


def response(spectra: DataFrame, options: FrfOptions) -> DataFrame:
    """H, dynamic coefficient, validity, coherence and reference amplitude from the sums, which
    come with length, segments, step and peak.

    A bin (not the first) is valid if the reference's power there exceeds both its strongest
    bin's times the squared threshold and the rounding noise of samples as large as the peak."""
    length, segments = F.col("length"), F.col("segments")
    top = F.max(F.when(F.col("bin") >= 1, F.col("sxx"))).over(Window.partitionBy(*SERIES))
    noise = F.pow(F.col("peak") * (32 * EPS) * length, F.lit(2.0)) * segments
    valid = (F.col("bin") >= 1) & (F.col("sxx") > F.greatest(noise, top * options.threshold**2))
    rows = spectra.withColumn("valid", valid)
    h = lambda c: F.when(F.col("valid"), F.try_divide(F.col(c), F.col("sxx")))
    known = F.col("valid") & F.lit(options.estimator == "h1") & (segments >= 2) & (F.col("syy") > 0)
    power = F.col("sxy_re") ** 2 + F.col("sxy_im") ** 2
    edge = 2 * F.col("bin") == length
    rows = rows.select(
        *SERIES, "bin", (F.col("bin") / (length * F.col("step"))).alias("freq"), h("sxy_re").alias("h_re"), h("sxy_im").alias("h_im"), "valid",
        F.when(known, F.least(F.greatest(F.try_divide(power, F.col("sxx") * F.col("syy")), F.lit(0.0)), F.lit(1.0))).alias("coherence"),
        known.alias("coherence_valid"),
        F.when(F.col("bin") >= 1, F.when(edge, 1.0).otherwise(2.0) * F.sqrt(F.col("sxx") / segments) / (0.5 * length)).alias("reference_amplitude"),
        (F.col("bin") >= 1).alias("reference_valid"),
    )
    return rows.withColumn("dynamic_coefficient", F.sqrt(F.col("h_re") ** 2 + F.col("h_im") ** 2))


def analyze_frf(long: DataFrame, references: Sequence[str], responses: Sequence[str], options: FrfOptions = FrfOptions()) -> DataFrame:
    """(recording_id, channel, bin, freq, h_re, h_im, valid, coherence, coherence_valid,
    reference_amplitude, reference_valid, dynamic_coefficient) for each response channel of each
    recording that ``frf_status`` finds nothing against; an error if there is none.

    Gaps are ignored: samples follow each other whatever their times."""
    facts = settle(inspect(long, references, responses, options))
    if not facts.where("status = 'None'").limit(1).count():
        row = facts.orderBy("recording_id").first()
        kind = row["status"] if row else "TooShort"
        raise RecordingError(kind, ERRORS[kind])
    facts = facts.where("status = 'None'")
    own = facts.select("recording_id", "length", "hop", "segments", F.explode("good").alias("channel"))
    y = long.where(F.col("channel").isin(*responses)).select(*SERIES, "sample", F.col("value").alias("y"))
    prepared = y.join(own, list(SERIES)).join(averaged(long, references), ["recording_id", "sample"])
    spectra = cross_spectra(prepared, options.remove_mean).join(facts.select("recording_id", "length", "segments", "step", "peak"), "recording_id")
    return response(spectra, options)


def require_reference(result: DataFrame) -> DataFrame:
    """The result; Overflow if its sums are beyond numbers, WeakReference if no bin is valid."""
    if result.where("bin >= 1").where(~finite(F.col("reference_amplitude")) | F.col("valid") & ~finite(F.col("h_re"))).limit(1).count():
        raise RecordingError("Overflow", ERRORS["Overflow"])
    if not result.where("valid").limit(1).count():
        raise RecordingError("WeakReference", ERRORS["WeakReference"])
    return result


def analyze_pair(long: DataFrame, reference: str, response_channel: str, options: FrfOptions = FrfOptions()) -> DataFrame:
    return analyze_frf(long, [reference], [response_channel], options)


def smooth(result: DataFrame, octaves: float = 1 / 12, column: str = "dynamic_coefficient") -> DataFrame:
    """Adds smoothed, the mean of finite values within half of ``octaves`` either side.

    Bins are evenly spaced and count 0, 1, 2, ..., so the neighbours of bin k are those from
    k / span up to k * span: a mean is a difference of two running sums, fetched by bin.  No task
    holds a channel; bins whose neighbours reach beyond the last one take the channel's total."""
    ok = finite(F.col(column))
    rows = running_sum(result.where("bin >= 1"), {"__sum": F.when(ok, F.col(column)), "__n": ok.cast("long")}, order="bin")
    rows = sums = Scratch(result.sparkSession).save(rows)
    total = rows.groupBy(*SERIES).agg(F.max("bin").alias("__last"), F.max_by("__sum", "bin").alias("__all"), F.max("__n").alias("__count"))
    span = 2.0 ** (octaves / 2)
    upto = F.floor(F.col("bin") * span)
    rows = rows.join(settle(total), list(SERIES)).withColumn("__below", F.ceil(F.col("bin") / span) - 1).withColumn("__upto", F.when(upto < F.col("__last"), upto))
    at = lambda place: sums.select(*SERIES, F.col("bin").alias(place), F.col("__sum").alias(f"{place}_sum"), F.col("__n").alias(f"{place}_n"))
    rows = rows.join(at("__below"), [*SERIES, "__below"], "left").join(at("__upto"), [*SERIES, "__upto"], "left")
    part = lambda kind, every: F.coalesce(F.col(f"__upto_{kind}"), F.col(every)) - F.coalesce(F.col(f"__below_{kind}"), F.lit(0))
    mean = F.try_divide(part("sum", "__all"), part("n", "__count").cast("double"))
    return rows.withColumn("smoothed", F.when(F.col(column).isNotNull(), mean)).select(*result.columns, "smoothed")


def frf_rows(result: DataFrame) -> DataFrame:
    """The rows of an FRF file: without the zero bin, responses numbered from 1."""
    names = result.select("channel").distinct().withColumn("response_index", F.row_number().over(Window.orderBy("channel")))
    rows = result.where("bin >= 1").join(F.broadcast(names), "channel")
    return rows.select(F.col("freq").alias("frequency_hz"), "dynamic_coefficient", F.col("h_re").alias("h_real"), F.col("h_im").alias("h_imag"), F.col("valid").cast("int").alias("valid"), "coherence", F.col("coherence_valid").cast("int").alias("coherence_valid"), "reference_amplitude", F.col("reference_valid").cast("int").alias("reference_valid"), "response_index", F.col("channel").alias("response_name"))
