"""More queries: file formats, streams and the command line, each with its SQL."""

from __future__ import annotations

import csv
import io
import uuid

from pyspark.sql import functions as F

from wavemill.operators import filters, frf, spectrum, stats
from wavemill.plans import recipe
from wavemill.plans.catalog import DAYS, DAYS_WIDE, DFT_WAVES, EV, FLAGS, FRF_ROWS, HOUR, HOURS, ORACLE_SQL, R, daily, daily_wide, events, frf_sql, hourly, query, reset_axis, shared_file, waveforms
from wavemill.recording import long_to_wide
from wavemill.scratch import Scratch, settle, shared_dir
from wavemill.sources import export, recording_file
from wavemill.sources.text_writer import Layout, write_ordered
from wavemill.streaming import recording_stream, source, stateful


# Files -------------------------------------------------------------------------------------

DAY_ROWS = f"WITH {DAYS_WIDE} SELECT channel, CAST(sample AS BIGINT) AS sample, {R('t')}, {R('value')} FROM (SELECT 'A' AS channel, sample, t, a AS value FROM w UNION ALL SELECT 'N', sample, t, n FROM w)"
LONG = ["channel", "sample", "t", "value"]


@query(DAY_ROWS)
def lvm_round_trip_daily(spark, sf_dir):
    """A LabVIEW measurement file (dated header, pairs of time and channel) and back; the times
    that each channel repeats are found and dropped."""
    path = shared_file(spark, "daily.lvm")
    export.write_lvm(daily(spark, sf_dir), path, ["A", "N"])
    return recording_file.read_recording(spark, path, checkpoint=500).select(*LONG)


@query(DAY_ROWS.replace("'A' AS channel", "'Channel_1' AS channel").replace("SELECT 'N'", "SELECT 'Channel_2'"))
def tab_file_round_trip_daily(spark, sf_dir):
    """Tab-separated text; a line that begins with Time is metadata there, so names are lost."""
    path = shared_file(spark, "daily.txt")
    export.write_file(daily(spark, sf_dir), path, ["A", "N"])
    return recording_file.read_recording(spark, path, checkpoint=500).select(*LONG)


@query(f"""WITH {DAYS_WIDE}, n AS (SELECT count(*) AS c FROM w), x AS (SELECT * REPLACE (CASE WHEN sample >= 100 THEN t + 100 ELSE t END AS t) FROM w),
y AS (SELECT 'A' AS channel, sample, t, a AS value FROM x UNION ALL SELECT 'N', sample, t, n FROM x UNION ALL SELECT 'R', sample, t, r FROM x)
SELECT channel, sample, {R('t')}, {R('value')} FROM y""")
def sections_by_date_daily(spark, sf_dir):
    """Two sections, the second's clock a hundred seconds ahead of the first one's."""
    path = shared_file(spark, "sections.lvm")
    head = "Date\t2024/05/01\t\nTime\t10:0{}\t\nX0\t0\t\n***End_of_Header***\n"
    first = F.when(F.col("sample") == 0, head.format("0:00") + "X_Value\tA\tN\tR\tComment\n").when(F.col("sample") == 100, head.format("1:40")).otherwise("")
    rows = daily_wide(spark, sf_dir).orderBy("sample")
    cells = [F.col(c).cast("string") for c in ("t", *FLAGS)]
    write_ordered(rows.select(F.concat(first, F.concat_ws("\t", *cells, F.lit("")), F.lit("\n"))), path, layout=Layout(raw=True))
    return recording_file.read_recording(spark, path).select("channel", "sample", "t", "value")


@query(f"""WITH {DAYS_WIDE} SELECT channel, CAST(sample AS BIGINT) AS sample, {R('t')}, {R('value')} FROM (SELECT 'A' AS channel, sample, t, a AS value FROM w UNION ALL SELECT 'N', sample, t, n FROM w UNION ALL SELECT 'R', sample, t, r FROM w)
WHERE (channel = 'A' AND t BETWEEN 864000 AND 86400000) OR (channel = 'R' AND sample >= 100 AND t < 50000000)""")
def pushed_filters_daily(spark, sf_dir):
    """Two conditions on one file, taken over by the source: stretches outside aren't read, other channels' cells aren't parsed."""
    path = shared_file(spark, "daily.csv")
    export.write_file(daily(spark, sf_dir), path, ["A", "N", "R"])
    one = recording_file.read_where(spark, "channel = 'A' AND t BETWEEN 864000 AND 86400000", path, checkpoint=200)
    two = recording_file.read_where(spark, "channel IN ('R') AND sample >= 100 AND t < 50000000", path, checkpoint=200)
    return one.unionByName(two).select(*LONG)


@query(f"""WITH {DAYS_WIDE} SELECT channel, CAST(sample AS BIGINT) AS sample, {R('t + CAST(floor(sample / 50) AS BIGINT) * 10', 't')}, {R('value')}
FROM (SELECT 'A' AS channel, sample, t, a AS value FROM w UNION ALL SELECT 'N', sample, t, n FROM w UNION ALL SELECT 'R', sample, t, r FROM w)""")
def many_sections_daily(spark, sf_dir):
    """A file with a dated section for each fifty days, each clock ten seconds further ahead, whose index is made over
    ranges of 16 KB."""
    path = shared_file(spark, "many.lvm")
    days = long_to_wide(daily(spark, sf_dir), ["A", "N", "R"])
    k = 10 * F.floor(F.col("sample") / 50)
    head = F.format_string("Date\t2024/05/01\t\nTime\t%d:%02d:%02d\t\nX0\t0\t\n***End_of_Header***\n%s", 10 + F.floor(k / 3600), F.floor(k / 60) % 60, k % 60, F.when(F.col("sample") == 0, "X_Value\tA\tN\tR\n").otherwise(""))
    row = F.concat_ws("\t", *(F.col(c).cast("string") for c in ("t", "A", "N", "R")))
    write_ordered(days.orderBy("sample").select(F.concat(F.when(F.col("sample") % 50 == 0, head).otherwise(""), row, F.lit("\n"))), path, layout=Layout(raw=True))
    folder = f"{path}.index"
    if rest := recording_file.make_indexes(spark, [path], folder, True, 100, width=1 << 14):
        raise RuntimeError(f"{rest} were read by one task")
    return recording_file.read_recording(spark, path, checkpoint=100, index=folder).select(*LONG)


@query(DAY_ROWS)
def stream_recording_file_daily(spark, sf_dir):
    """A recording file as a stream, in micro-batches of 8 KB, from its first byte to its last."""
    path, scratch = shared_file(spark, "stream.csv"), Scratch(spark)
    export.write_file(daily(spark, sf_dir), path, ["A", "N"])
    rows = recording_stream.stream_recording(spark, path, max_bytes=8192, checkpoint=100)
    out = f"{scratch.root}/rows"
    running = rows.writeStream.format("parquet").option("checkpointLocation", f"{scratch.root}/state").option("path", out).trigger(processingTime="0 seconds").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.schema(rows.schema).parquet(out).select(*LONG)


@query(f"WITH {DAYS} SELECT {R('min(t)', 't_start')}, {R('max(t)', 't_end')}, (SELECT count(*) FROM w) AS data_rows, 4 AS max_columns FROM ev")
def scan_time_bounds_daily(spark, sf_dir):
    path = shared_file(spark, "daily.csv")
    export.write_file(daily(spark, sf_dir), path, ["A", "N", "R"])
    index = recording_file.indexed(spark, path, checkpoint=500)
    return spark.createDataFrame([(*index.bounds, index.data_rows, index.max_columns)], "t_start double, t_end double, data_rows long, max_columns int")


@query(DAY_ROWS.replace("'A' AS channel, sample, t, a AS value FROM w UNION ALL SELECT 'N', sample, t, n FROM w", "'R' AS channel, sample, t, r AS value FROM w UNION ALL SELECT 'A', sample, t, a FROM w"))
def channel_subset_daily(spark, sf_dir):
    """The third and the first channel of a file, by position."""
    path = shared_file(spark, "daily.csv")
    export.write_file(daily(spark, sf_dir), path, ["A", "N", "R"])
    return recording_file.read_recording(spark, path, channels="3,1").select(*LONG)


@query(f"WITH {DAYS_WIDE} SELECT rid, count(*) AS n, {R('sum(value)', 'total')} FROM (SELECT 'one/x.csv' AS rid, a AS value FROM w UNION ALL SELECT 'two/x.csv', n FROM w) GROUP BY rid")
def recordings_of_one_name_daily(spark, sf_dir):
    """Two files of one name in two folders are two recordings."""
    long = daily(spark, sf_dir)
    folder = shared_file(spark, "")
    paths = []
    for name, channel in (("one", "A"), ("two", "N")):
        paths.append(f"{folder}{name}/x.csv")
        export.make_folder(paths[-1])
        export.write_file(long, paths[-1], [channel])
    got = recording_file.read_recording(spark, *paths)
    return got.groupBy(F.col("recording_id").alias("rid")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"WITH {EV}, x AS (SELECT *, t - floor(sample / 50) * 40000.0 AS raw FROM ev) SELECT channel, sample, {R('raw', 'raw_t')}, {R('value')} FROM x")
def raw_times_view(spark, sf_dir):
    """A clock that starts again stays as it is where strictly increasing times aren't asked for; a
    file for each channel, because each has times of its own."""
    long = settle(reset_axis(events(spark, sf_dir)))
    folder, paths = shared_file(spark, ""), []
    for r in long.select("channel").distinct().orderBy("channel").collect():
        paths.append(f"{folder}{len(paths)}.csv")
        export.write_file(long.where(F.col("channel") == r["channel"]), paths[-1], [r["channel"]], order="sample")
    return recording_file.read_recording(spark, *paths, monotonic=False, checkpoint=64).select("channel", "sample", "raw_t", "value")


FRF_FILE = frf_sql(64) + f", fr AS ({FRF_ROWS.replace('@L', '64')}) SELECT micro_hz, h_re AS h_real, h_im AS h_imag, CAST(valid AS INT) AS valid, coherence, reference_amplitude, CAST(1 AS INT) AS response_index, 'N' AS response_name FROM fr WHERE bin >= 1"


@query(FRF_FILE)
def frf_file_daily(spark, sf_dir):
    """A frequency response written as a file, read back as plain CSV."""
    path = shared_file(spark, "frf.csv")
    result = frf.analyze_frf(daily(spark, sf_dir), ["A", "R"], ["N"], frf.FrfOptions(segment_length=64))
    export.write_frf_file(frf.frf_rows(result), path, several=True)
    kinds = ", ".join(f"{c} {'int' if c in ('valid', 'coherence_valid', 'reference_valid', 'response_index') else 'double'}" for c in export.FRF_COLUMNS)
    rows = spark.read.schema(f"{kinds}, response_index int, response_name string").option("comment", "#").option("header", True).csv(f"file://{path}")
    return rows.select((F.col("frequency_hz") * 1e6).alias("micro_hz"), "h_real", "h_imag", "valid", "coherence", "reference_amplitude", "response_index", "response_name")


@query(DFT_WAVES + f" SELECT channel, count(*) AS bins, {R('max(amp)', 'top')} FROM sp GROUP BY channel")
def stored_result_waveforms(spark, sf_dir):
    """A result stored under its recipe and its sources' stamps, and read again from there."""
    folder = f"{shared_dir(spark)}/wavemill-results-{uuid.uuid4().hex}"
    for _ in range(2):
        got = export.store_result(spectrum.amplitude_spectrum(waveforms(spark, sf_dir)), folder, "spectrum", [f"{sf_dir}/embeddings.parquet"])
    return got.groupBy("channel").agg(F.count("*").alias("bins"), F.max("amp").alias("top"))


@query(f"WITH {DAYS_WIDE}, x AS (SELECT 'A' AS channel, a AS value FROM w UNION ALL SELECT 'R', r FROM w) SELECT channel, count(*) AS n, {R('min(value)', 'lowest')}, {R('max(value)', 'highest')}, round(avg(value), 4) AS mean FROM x GROUP BY channel", 4)
def command_line_stats_daily(spark, sf_dir):
    """What the command line prints for two channels of a file."""
    path, out = shared_file(spark, "daily.csv"), io.StringIO()
    export.write_file(daily(spark, sf_dir), path, ["A", "N", "R"])
    if recipe.run([path, "--stats", "--channels", "1,3"], spark, out):
        raise RuntimeError("the command line failed")
    rows = [(c, int(n), float(lo), float(hi), float(mean)) for c, n, lo, hi, mean in csv.reader(io.StringIO(out.getvalue()), delimiter="\t")]
    return spark.createDataFrame(rows, "channel string, n long, lowest double, highest double, mean double")


# Selection ---------------------------------------------------------------------------------

@query(f"WITH {EV}, x AS (SELECT * REPLACE (CASE channel WHEN 'view' THEN sqrt(CASE WHEN 2 * value - 50 >= 0 THEN 2 * value - 50 END) ELSE 2 * value - 50 END AS value) FROM ev WHERE channel IN ('view', 'click') AND t BETWEEN 3600 AND 400000) SELECT channel, sample, {R('t')}, round(value, 6) AS value FROM x")
def recipe_events(spark, sf_dir):
    """A recipe: channels, a formula for all and one for a channel, and a time window."""
    r = recipe.Recipe(3600.0, 400000.0, ("view", "click"), "2*x - 50", {"view": "sqrt(x)"})
    return r.apply(events(spark, sf_dir)).select("channel", "sample", "t", "value")


@query(f"WITH {EV} SELECT {R('greatest(min(t), 3600.5)', 'start')}, {R('least(max(t), 1e12)', 'stop')} FROM ev")
def clamped_range_events(spark, sf_dir):
    lo, hi = stats.resolve_range(events(spark, sf_dir), 3600.5, 1e12, clamp=True)
    return spark.createDataFrame([(lo, hi)], "start double, stop double")


# Filters with resets -----------------------------------------------------------------------

def reset_rows(spark, sf_dir):
    """The hourly sums with missing values, jumps ahead and times that stand still."""
    h = hourly(spark, sf_dir)
    t = F.col("t") + F.when(F.col("sample") >= 200, 1e6).otherwise(0.0) - F.when(F.col("sample") == 300, 3600.0).otherwise(0.0)
    return h.withColumn("t", t).withColumn("value", F.when(F.col("sample") % 111 == 50, F.lit(None)).otherwise(F.col("value")))


def reset_sql(settings: filters.FilterSettings) -> str:
    """The recurrence with its resets, sample by sample."""
    sections, subtract = filters.cascade(settings)
    states, steps, names = [], [], []
    for i, (b0, b1, b2, a1, a2) in enumerate(sections):
        x = "v.value" if i == 0 else f"({names[-1]})"
        p, q = (f"(CASE WHEN v.fresh OR f.gone THEN 0 ELSE f.{c}{i} END)" for c in "pq")
        y = f"{b0!r} * {x} + {p}"
        names.append(y)
        states += [f"0.0::DOUBLE AS p{i}", f"0.0::DOUBLE AS q{i}"]
        steps += [f"coalesce({b1!r} * {x} - {a1!r} * ({y}) + {q}, 0)", f"coalesce({b2!r} * {x} - {a2!r} * ({y}), 0)"]
    out = f"v.value - ({names[-1]})" if subtract else names[-1]
    limit = filters.RESET_STEPS * settings.step
    return f"""WITH RECURSIVE {HOURS}, r AS (SELECT sample, t + CASE WHEN sample >= 200 THEN 1e6 ELSE 0 END - CASE WHEN sample = 300 THEN 3600 ELSE 0 END AS t,
  CASE WHEN sample % 111 = 50 THEN NULL ELSE value END AS value FROM ev),
v AS MATERIALIZED (SELECT sample, t, value, coalesce(t - lag(t) OVER (ORDER BY sample) <= 0 OR t - lag(t) OVER (ORDER BY sample) > {limit!r}, true) AS fresh FROM r),
f AS (SELECT -1::BIGINT AS sample, 0.0::DOUBLE AS y, true AS gone, {', '.join(states)}
UNION ALL SELECT v.sample, {out}, v.value IS NULL, {', '.join(steps)} FROM f JOIN v ON v.sample = f.sample + 1)
SELECT v.sample, {R('t')}, round(f.y, 6) + 0.0 AS value FROM f JOIN v USING (sample)"""


RESET_FILTERS = {
    f"filter_resets_{family}_{mode}": filters.FilterSettings(mode, family, 0.02 / HOUR, 0.2 / HOUR, HOUR)
    for family, mode in (("butterworth", "lowpass"), ("bessel", "highpass"), ("chebyshev", "bandpass"), ("linkwitz_riley", "bandstop"))
}


def _reset_query(settings):
    def run(spark, sf_dir):
        return filters.filter_channels(reset_rows(spark, sf_dir), settings, block=100).select("sample", "t", "value")

    return run


for _name, _settings in RESET_FILTERS.items():
    _run = _reset_query(_settings)
    _run.__name__ = _name
    query(reset_sql(_settings))(_run)


# Streams -----------------------------------------------------------------------------------

def streamed(spark, long, transform, keep, mode: str = "append", stretch: int = 400):
    """What a stream over the recording, a stretch of ``stretch`` samples or more at a time, has put out in the
    end; ``keep`` are the columns that tell results apart (the last one counts; of a complete result
    only the last one is kept)."""
    folder = Scratch(spark).root
    source.write_stretches(long, f"{folder}/in", source.stretch_length(long, stretch))
    out = f"{folder}/out"

    def put(batch, number):
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    stream = transform(source.read_stretches(spark, f"{folder}/in", long.schema))
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    rows = spark.read.parquet(out)
    names = [c for c in rows.columns if c not in (*keep, "__batch")]
    return rows.groupBy(*keep).agg(F.max_by(F.struct(*names), "__batch").alias("r")).select(*keep, "r.*")


KEYS = ("recording_id", "channel")


@query(f"WITH {EV} SELECT recording_id, channel, CAST(floor(sample / 256) AS BIGINT) AS bucket, {R('min(value)', 'low')}, {R('max(value)', 'high')}, count(value) AS finite_count, count(*) AS sample_count FROM ev GROUP BY ALL")
def stream_buckets_events(spark, sf_dir):
    return streamed(spark, events(spark, sf_dir), lambda s: stateful.bucket_stream(s, 256), (*KEYS, "bucket"), "update")


@query(f"WITH {EV} SELECT recording_id, channel, count(value) AS n, {R('min(value)', 'min_value')}, {R('max(value)', 'max_value')}, {R('avg(value)', 'mean_value')} FROM ev GROUP BY ALL")
def stream_stats_events(spark, sf_dir):
    return streamed(spark, events(spark, sf_dir), stateful.stats_stream, KEYS, "update")


def _stamped(s):
    return s.withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")))


@query(f"""WITH {EV}, d AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY channel ORDER BY t, sample) >= 1800, true) AS cut FROM ev),
s AS (SELECT *, sum(cut::INT) OVER (PARTITION BY channel ORDER BY t, sample ROWS UNBOUNDED PRECEDING) AS run FROM d)
SELECT channel, {R('min(t)', 'start')}, count(*) AS n, {R('min(value)', 'min_value')}, {R('max(value)', 'max_value')} FROM s GROUP BY channel, run""", 6)
def stream_sessions_events(spark, sf_dir):
    def run(s):
        rows = stateful.session_stream(_stamped(s), 1800.0, late="3650 days")
        return rows.select("channel", (F.unix_micros("session_window.start") / 1e6).alias("start"), "n", "min_value", "max_value")

    return streamed(spark, events(spark, sf_dir), run, ("channel", "start"), "complete")


@query(f"""WITH {EV}, x AS (SELECT channel, value, unnest([floor(t / 43200), floor(t / 43200) - 1]) AS k FROM ev)
SELECT channel, {R('k * 43200.0', 'start')}, count(*) AS n, {R('avg(value)', 'mean_value')} FROM x GROUP BY ALL""")
def stream_sliding_events(spark, sf_dir):
    def run(s):
        rows = stateful.welch_stream_windows(_stamped(s), 86400.0, late="3650 days")
        return rows.select("channel", (F.unix_micros("window.start") / 1e6).alias("start"), "n", "mean_value")

    return streamed(spark, events(spark, sf_dir), run, ("channel", "start"), "complete")


@query(reset_sql(RESET_FILTERS["filter_resets_chebyshev_bandpass"]))
def stream_filter_resets(spark, sf_dir):
    s = RESET_FILTERS["filter_resets_chebyshev_bandpass"]
    return streamed(spark, reset_rows(spark, sf_dir), lambda rows: stateful.filter_stream(rows, s), (*KEYS, "sample"), stretch=97).select("sample", "t", "value")


@query(ORACLE_SQL["monotonic_events"])
def stream_monotonic_events(spark, sf_dir):
    return streamed(spark, reset_axis(events(spark, sf_dir)), stateful.monotonic_stream, (*KEYS, "sample"))
