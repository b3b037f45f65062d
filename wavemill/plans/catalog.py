"""Queries over the driver's tables, one or more for each operator, with their SQL.

``events`` is a recording with a channel for each event type; its hourly sums are an evenly
clocked one; the daily sums of ``lineitem`` give aligned channels, one for each return flag;
each vector of ``embeddings`` is a short waveform.  Results are rounded to six places.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions import formula, scalars
from wavemill.operators import annotations, filters, frf, overview, spectrum, stats, timeline
from wavemill.operators.blocks import neighbours
from wavemill.operators.filter_states import FilterStates
from wavemill.operators.pyramid import build_pyramid
from wavemill.recording import from_rows, long_to_wide, wide_to_long
from wavemill.scratch import Scratch, shared_dir
from wavemill.sources import export, recording_file

QUERIES: dict = {}
ORACLE_SQL: dict = {}
FLAGS = ("A", "N", "R")
FLAGS_SQL = ", ".join(f"'{f}'" for f in FLAGS)


def query(sql: str | None = None, digits: int = 6):
    """Registers a query under its function's name; doubles are rounded, and -0 becomes 0."""

    def wrap(f):
        def run(spark, sf_dir):
            df = f(spark, sf_dir)
            return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


def tbl(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts, first):
    return (F.unix_micros(ts.cast("timestamp")) - first) / 1e6


def events(spark, sf_dir) -> DataFrame:
    e = tbl(spark, sf_dir, "events")
    first = e.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] or 0
    return from_rows(e, seconds(F.col("ts"), first), F.col("value"), F.col("event_type"), [F.col("ts"), F.col("event_id")])


def hourly(spark, sf_dir) -> DataFrame:
    e = tbl(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.sum("value").alias("v"))
    first = e.agg(F.min(F.unix_micros("h"))).first()[0] or 0
    return from_rows(e, (F.unix_micros("h") - first) / 1e6, F.col("v"), F.lit("hourly"), [F.col("h")])


def daily_wide(spark, sf_dir) -> DataFrame:
    """A row for each ship date with a column for each return flag; 0 where nothing shipped."""
    li = tbl(spark, sf_dir, "lineitem")
    d = li.groupBy(F.to_date("l_shipdate").alias("d")).agg(*(F.coalesce(F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))), F.lit(0.0)).alias(f) for f in FLAGS))
    days = from_rows(d.withColumn("x", F.struct(*FLAGS)), F.datediff("d", F.lit("1995-01-01")) * 86400.0, F.lit(0.0), F.lit("x"), [F.col("d")])
    return days.select("recording_id", "sample", "t").join(d.withColumn("t", F.datediff("d", F.lit("1995-01-01")) * 86400.0), "t").select("recording_id", "sample", "t", *FLAGS)


def daily(spark, sf_dir) -> DataFrame:
    return wide_to_long(daily_wide(spark, sf_dir), FLAGS)


def waveforms(spark, sf_dir) -> DataFrame:
    e = tbl(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("channel"), F.posexplode("embedding").alias("i", "v"))
    return e.select(F.lit("r").alias("recording_id"), "channel", F.col("i").cast("long").alias("sample"), (F.col("i") / 1000.0).alias("t"), F.col("v").cast("double").alias("value"))


EV = """ev AS (SELECT 'r' AS recording_id, event_type AS channel, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS sample,
  (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 AS t, value FROM events)"""
HOURS = """hh AS (SELECT date_trunc('hour', ts) AS h, sum(value) AS value FROM events GROUP BY 1),
ev AS (SELECT 'r' AS recording_id, 'hourly' AS channel, row_number() OVER (ORDER BY h) - 1 AS sample,
  (epoch_us(h) - (SELECT min(epoch_us(h)) FROM hh)) / 1e6 AS t, value FROM hh)"""
DAYS_WIDE = """dd AS (SELECT CAST(l_shipdate AS DATE) AS d, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS a,
  coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS n, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS r FROM lineitem GROUP BY 1),
w AS (SELECT 'r' AS recording_id, row_number() OVER (ORDER BY d) - 1 AS sample, date_diff('day', DATE '1995-01-01', d) * 86400.0::DOUBLE AS t, a, n, r FROM dd)"""
DAYS = (
    DAYS_WIDE
    + """, ev AS (SELECT recording_id, 'A' AS channel, sample, t, a AS value FROM w UNION ALL
  SELECT recording_id, 'N', sample, t, n FROM w UNION ALL SELECT recording_id, 'R', sample, t, r FROM w)"""
)
WAVES = """ev AS (SELECT 'r' AS recording_id, CAST(vec_id AS VARCHAR) AS channel, i AS sample, i / 1000.0::DOUBLE AS t,
  CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range(0, 64) AS g(i))"""
DT = "iv AS (SELECT *, lag(t) OVER (PARTITION BY channel ORDER BY sample) AS t_before, t - lag(t) OVER (PARTITION BY channel ORDER BY sample) AS dt FROM ev)"
CADENCE = (
    DT
    + """,
d AS (SELECT channel, dt, row_number() OVER (PARTITION BY channel ORDER BY dt) - 1 AS i, dt / lag(dt) OVER (PARTITION BY channel ORDER BY dt) AS r FROM iv WHERE dt > 0),
c AS (SELECT channel, count(*) AS n, min(i) FILTER (i >= 2 AND r > 4) AS i4, min(i) FILTER (i >= 2 AND r > 1.5) AS i15 FROM d GROUP BY channel),
b AS (SELECT channel, median(dt) FILTER (i < i15) AS base FROM d JOIN c USING (channel) GROUP BY channel),
f AS (SELECT channel, bool_and(coalesce(dt / base >= 0.95 AND abs(dt / base - round(dt / base)) <= 0.05, false)) AS fits FROM d JOIN b USING (channel) GROUP BY channel),
k AS (SELECT channel, n, CASE WHEN i15 < coalesce(i4, n + 1) AND fits THEN i15 ELSE coalesce(i4, n) END AS kept FROM c JOIN f USING (channel)),
cad AS (SELECT channel, median(dt) FILTER (i < kept) AS cadence, any_value(n) AS n_intervals FROM d JOIN k USING (channel) GROUP BY channel)"""
)
R = lambda c, a=None: f"round({c}, 6) + 0.0 AS {a or c}"


# Selection and statistics ------------------------------------------------------------------

@query(f"WITH {EV} SELECT recording_id, channel, count(value) AS n, {R('min(value)', 'min_value')}, {R('max(value)', 'max_value')}, {R('avg(value)', 'mean_value')} FROM ev GROUP BY ALL")
def channel_stats_events(spark, sf_dir):
    return stats.channel_stats(events(spark, sf_dir))


@query(f"WITH {EV}, p AS (SELECT recording_id, channel, count(*) AS rows, min(t) AS t0, max(t) AS t1 FROM ev GROUP BY ALL) SELECT recording_id, max(rows) AS n_rows, count(*) AS n_channels, {R('min(t0)', 't_start')}, {R('max(t1)', 't_end')} FROM p GROUP BY ALL")
def recording_info_events(spark, sf_dir):
    return stats.recording_info(events(spark, sf_dir))


@query(f"WITH {EV} SELECT recording_id, channel, sample, {R('t')}, {R('value')} FROM ev WHERE sample < 10")
def head_events(spark, sf_dir):
    return stats.head(events(spark, sf_dir), 10)


@query(f"WITH {EV}, p(channel, position) AS (VALUES ('view', 0), ('click', 1), ('view', 2)) SELECT recording_id, channel, sample, {R('t')}, {R('value')}, position FROM ev JOIN p USING (channel)")
def select_channels_events(spark, sf_dir):
    return stats.select_channels(events(spark, sf_dir), ["view", "click", "view"])


@query(f"WITH {EV} SELECT recording_id, channel, sample, {R('t')}, {R('value')} FROM ev WHERE t >= 3600 AND t <= 90000")
def time_range_events(spark, sf_dir):
    return stats.time_range(events(spark, sf_dir), 3600.0, 90000.0)


@query(f"WITH {EV} SELECT recording_id, channel, count(*) FILTER (t < 3600) AS first, count(*) FILTER (t <= 90000) AS past FROM ev GROUP BY ALL")
def sample_range_events(spark, sf_dir):
    return stats.sample_range(events(spark, sf_dir), 90000.0, 3600.0)


@query(f"WITH {EV} SELECT recording_id, channel, {R('min(value)', 'min_value')}, {R('max(value)', 'max_value')}, count(*) AS n FROM ev WHERE sample >= 17 AND sample < 170 GROUP BY ALL")
def envelope_events(spark, sf_dir):
    return stats.envelope(events(spark, sf_dir), 17, 170)


@query(f"WITH {EV} SELECT recording_id, {R('min(value) - 0.05 * (max(value) - min(value))', 'y_lo')}, {R('max(value) + 0.05 * (max(value) - min(value))', 'y_hi')} FROM ev GROUP BY ALL")
def auto_y_time_events(spark, sf_dir):
    return stats.auto_y_time(events(spark, sf_dir))


@query(f"WITH {DAYS_WIDE} SELECT recording_id, sample, {R('t')}, {R('a', 'A')}, {R('r', 'R')} FROM w")
def aligned_channels_daily(spark, sf_dir):
    return long_to_wide(daily(spark, sf_dir), ["A", "R"])


# Time axis ---------------------------------------------------------------------------------

def reset_axis(ev: DataFrame) -> DataFrame:
    """Every 50 samples the clock starts again, as in a recording of several sections."""
    return ev.withColumn("t", F.col("t") - F.floor(F.col("sample") / 50) * 40000.0)


@query(f"""WITH {EV}, x AS (SELECT * EXCLUDE t, t - floor(sample / 50) * 40000.0 AS t FROM ev),
d AS (SELECT *, t - lag(t) OVER (PARTITION BY channel ORDER BY sample) AS d FROM x),
s AS (SELECT *, coalesce(last_value(CASE WHEN d > 0 THEN d END IGNORE NULLS) OVER (PARTITION BY channel ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e-6) AS st FROM d)
SELECT recording_id, channel, sample, {R("t + sum(CASE WHEN d <= 0 THEN st - d ELSE 0 END) OVER (PARTITION BY channel ORDER BY sample ROWS UNBOUNDED PRECEDING)", "t")}, {R('value')} FROM s""", 6)
def monotonic_events(spark, sf_dir):
    return timeline.monotonic(reset_axis(events(spark, sf_dir)))


ORACLE_SQL["monotonic_exact_events"] = ORACLE_SQL["monotonic_events"]


def broken_axis(ev: DataFrame) -> DataFrame:
    """Every ninth time repeats the one before it; every fiftieth is missing."""
    rows = neighbours(ev, {"t_before": ("t", -1)})
    t = F.when(F.col("sample") % 50 == 49, F.lit(None)).when((F.col("sample") % 9 == 8), F.col("t_before")).otherwise(F.col("t"))
    return rows.withColumn("t", t).drop("t_before")


BROKEN = f"""{EV.replace('ev AS', 'raw AS', 1)}, ev AS (SELECT * REPLACE (CASE WHEN sample % 50 = 49 THEN NULL WHEN sample % 9 = 8 THEN lag(t) OVER (PARTITION BY channel ORDER BY sample) ELSE t END AS t) FROM raw)"""


@query(f"""WITH {BROKEN}, x AS (SELECT * FROM ev WHERE t IS NOT NULL),
d AS (SELECT *, t - lag(t) OVER (PARTITION BY channel ORDER BY sample) AS d FROM x),
s AS (SELECT *, coalesce(last_value(CASE WHEN d > 0 THEN d END IGNORE NULLS) OVER (PARTITION BY channel ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e-6) AS st FROM d),
m AS (SELECT channel, sample, t + sum(CASE WHEN d <= 0 THEN st - d ELSE 0 END) OVER (PARTITION BY channel ORDER BY sample ROWS UNBOUNDED PRECEDING) AS moved FROM s)
SELECT recording_id, channel, sample, {R('moved', 't')}, {R('value')} FROM ev LEFT JOIN m USING (channel, sample)""")
def monotonic_missing_times(spark, sf_dir):
    return timeline.monotonic(broken_axis(events(spark, sf_dir)))


@query(f"WITH {BROKEN}, {CADENCE} SELECT 'r' AS recording_id, channel, {R('cadence')}, n_intervals FROM cad")
def cadence_repeated_times(spark, sf_dir):
    return timeline.cadence(broken_axis(events(spark, sf_dir)))


@query(f"""WITH {BROKEN}, {CADENCE} SELECT iv.recording_id, channel, count(*) AS n, {R('min(t)', 't_start')}, {R('max(t)', 't_end')}, {R('any_value(cadence)', 'cadence')},
coalesce(bool_or(dt > 1.5 * cadence), false) AS has_gaps, CASE WHEN count(*) < 4 THEN 'TooShort' WHEN bool_or(t IS NULL OR dt <= 0) THEN 'InvalidTime' ELSE 'OK' END AS status FROM iv JOIN cad USING (channel) GROUP BY ALL""")
def timeline_report_repeated_times(spark, sf_dir):
    return timeline.timeline_report(broken_axis(events(spark, sf_dir)))


@query()
def monotonic_exact_events(spark, sf_dir):
    return timeline.monotonic_exact(reset_axis(events(spark, sf_dir)))


@query(f"WITH {EV}, {CADENCE} SELECT 'r' AS recording_id, channel, {R('cadence')}, n_intervals FROM cad")
def cadence_events(spark, sf_dir):
    return timeline.cadence(events(spark, sf_dir))


@query(f"WITH {HOURS}, {CADENCE} SELECT 'r' AS recording_id, channel, {R('cadence')}, n_intervals FROM cad")
def cadence_hourly(spark, sf_dir):
    return timeline.cadence(hourly(spark, sf_dir))


@query(f"""WITH {EV}, {CADENCE} SELECT iv.recording_id, channel, count(*) AS n, {R('min(t)', 't_start')}, {R('max(t)', 't_end')}, {R('any_value(cadence)', 'cadence')},
coalesce(bool_or(dt > 1.5 * cadence), false) AS has_gaps, CASE WHEN count(*) < 4 THEN 'TooShort' WHEN coalesce(bool_or(dt <= 0), false) THEN 'InvalidTime' ELSE 'OK' END AS status FROM iv JOIN cad USING (channel) GROUP BY ALL""")
def timeline_report_events(spark, sf_dir):
    return timeline.timeline_report(events(spark, sf_dir))


GAPS = "g AS (SELECT iv.*, cadence, coalesce(dt > 1.5 * cadence, false) AS gap FROM iv JOIN cad USING (channel))"


@query(f"""WITH {EV}, {CADENCE}, {GAPS} SELECT recording_id, channel, sample, {R('t_before', '"left"')}, {R('t', '"right"')}, {R('dt', 'duration')}, greatest(0, CAST(round(dt / cadence) AS BIGINT) - 1) AS missing FROM g WHERE gap AND t >= 5000 AND t_before <= 500000""")
def gaps_events(spark, sf_dir):
    return timeline.gaps(events(spark, sf_dir), start=5000.0, end=500000.0)


SEGS = """sg AS (SELECT *, sum(gap::INT) OVER (PARTITION BY channel ORDER BY sample ROWS UNBOUNDED PRECEDING) AS segment FROM g),
ss AS (SELECT recording_id, channel, CAST(segment AS BIGINT) AS segment, min(t) AS t_start, max(t) AS t_end, count(*) AS n, any_value(cadence) AS cadence FROM sg GROUP BY ALL),
sd AS (SELECT *, first_value(t_start) OVER (PARTITION BY channel ORDER BY segment) + coalesce(sum(t_end - t_start + cadence) OVER (PARTITION BY channel ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS display_start FROM ss)"""


@query(f"WITH {EV}, {CADENCE}, {GAPS}, {SEGS} SELECT recording_id, channel, segment, {R('t_start')}, {R('t_end')}, n, {R('cadence')}, {R('display_start')} FROM sd")
def segments_events(spark, sf_dir):
    return timeline.segments(events(spark, sf_dir))


@query(f"WITH {EV}, {CADENCE}, {GAPS}, {SEGS} SELECT sg.recording_id, channel, sample, {R('t')}, {R('value')}, CAST(sg.segment AS BIGINT) AS segment, {R('display_start + t - t_start', 'display')} FROM sg JOIN sd USING (channel, segment)")
def stitched_events(spark, sf_dir):
    return timeline.stitched(events(spark, sf_dir))


@query(f"""WITH {EV}, {CADENCE}, {GAPS}, {SEGS} SELECT sg.recording_id, channel, sample, {R('(display_start + t - t_start) * pi()', 'pi_display')}, {R('t * pi()', 'pi_t')} FROM sg JOIN sd USING (channel, segment)""", 4)
def display_to_time_events(spark, sf_dir):
    ev = events(spark, sf_dir)
    places = timeline.stitched(ev).select("recording_id", "channel", "sample", "display")
    # Times pi, as times are whole microseconds and would round at ties.
    back = timeline.display_to_time(places, timeline.segments(ev))
    return back.select("recording_id", "channel", "sample", (F.col("display") * F.pi()).alias("pi_display"), (F.col("t") * F.pi()).alias("pi_t"))


ORACLE_SQL["display_to_time_events"] = ORACLE_SQL["display_to_time_events"].replace(", 6)", ", 4)")


@query(f"WITH {EV}, {DT} SELECT recording_id, channel, {R('median(dt)', 'step')} FROM iv WHERE dt > 0 AND sample % greatest(1, (SELECT count(*) // 4096 FROM ev e WHERE e.channel = iv.channel)) = 0 GROUP BY ALL")
def display_step_events(spark, sf_dir):
    return timeline.display_step(events(spark, sf_dir))


@query(f"WITH {DAYS} SELECT recording_id, channel, sample, {R('t')}, {R('value')} FROM ev WHERE channel <> 'R'")
def drop_duplicate_time_daily(spark, sf_dir):
    long = daily(spark, sf_dir)
    return timeline.drop_duplicate_time_channels(long.withColumn("value", F.when(F.col("channel") == "R", F.col("t")).otherwise(F.col("value"))))


# Formulas and scalars ----------------------------------------------------------------------

@query(f"""WITH {EV} SELECT recording_id, channel, sample, {R('value')}, {R('2 * value + 3', 'affine')},
round(CASE WHEN value - 100 > 0 THEN ln(value - 100) END, 6) AS logs, round(CASE WHEN 200 - value >= 0 THEN sqrt(200 - value) END, 6) AS roots,
{R('sin(value) * cos(value / 2) - abs(-value)', 'waves')}, {R('exp(-value / 100.0)', 'decay')}, round(CASE WHEN sample % 3 <> 0 THEN value / (sample % 3) END, 6) AS quotient FROM ev""")
def formula_events(spark, sf_dir):
    ev, x = events(spark, sf_dir), F.col("value")
    f = formula.compile_formula
    return ev.select(
        "recording_id", "channel", "sample", "value", f("2*x + 3", x).alias("affine"), f("LOG(x - 100)", x).alias("logs"), f("sqrt(200 - x)", x).alias("roots"),
        f("sin(x) * cos(x / 2) - abs(-x)", x).alias("waves"), f("exp(-x / 100,0)", x).alias("decay"), F.when(F.col("sample") % 3 != 0, f("x", x) / (F.col("sample") % 3)).alias("quotient"),
    )


@query(f"WITH {EV} SELECT recording_id, channel, sample, {R('(2 * value + 3) / 4 - 1', 'fused')}, round(CASE WHEN value * value - 2500 >= 0 THEN sqrt(value * value - 2500) END, 6) AS nested FROM ev")
def formula_composition_events(spark, sf_dir):
    x = F.col("value")
    return events(spark, sf_dir).select("recording_id", "channel", "sample", formula.compose("2*x+3", "x/4 - 1", x).alias("fused"), formula.compose("x*x - 2500", "sqrt(x)", x).alias("nested"))


@query("""SELECT p_partkey, round(try_cast(replace(replace(CAST(p_retailprice AS VARCHAR), '.', ','), ',', '.') AS DOUBLE), 6) AS price, CAST(NULL AS DOUBLE) AS not_a_number,
round(10 ** (log10(1.0) + (p_partkey % 11) / 10.0 * (log10(1000.0) - log10(1.0))), 6) AS log_frequency, round((p_partkey % 11) / 10.0 * 499 + 1, 6) AS linear_frequency,
round(500 * ((p_partkey % 11) / 10.0) ** 3, 6) AS cutoff, round((p_partkey % 11) / 10.0, 6) AS slider FROM part""")
def scalars_part(spark, sf_dir):
    p, u = tbl(spark, sf_dir, "part"), (F.col("p_partkey") % 11) / 10.0
    text = F.translate(F.col("p_retailprice").cast("string"), ".", ",")
    return p.select(
        "p_partkey", scalars.parse_number(text).alias("price"), scalars.parse_number(F.concat(text, F.lit("d"))).alias("not_a_number"), scalars.frequency_at(u, 1.0, 1000.0, True).alias("log_frequency"),
        scalars.frequency_at(u, 1.0, 500.0, False).alias("linear_frequency"), scalars.slider_to_cutoff(u, 500.0).alias("cutoff"), scalars.cutoff_to_slider(scalars.slider_to_cutoff(u, 500.0), 500.0).alias("slider"),
    )


# Overviews ---------------------------------------------------------------------------------

def _bucket_sql(bucket, keep="", extra="bucket"):
    spaced = "CASE WHEN sample % 64 <> 0 THEN dt END" if extra == "leaf" else "dt"
    return f"""SELECT recording_id, channel, CAST({bucket} AS BIGINT) AS bucket, min(sample) AS first_sample, max(sample) AS last_sample,
arg_min(sample, (value, sample)) AS low_sample, arg_max(sample, (value, -sample)) AS high_sample, {R('min(value)', 'low_value')}, {R('max(value)', 'high_value')}, count(*) AS finite_count, {R(f'max({spaced})', 'max_spacing')} FROM iv {keep} GROUP BY ALL"""


def _flat(o: DataFrame) -> DataFrame:
    return o.select("recording_id", "channel", "bucket", F.col("first.sample").alias("first_sample"), F.col("last.sample").alias("last_sample"), F.col("low.sample").alias("low_sample"), F.col("high.sample").alias("high_sample"), F.col("low.value").alias("low_value"), F.col("high.value").alias("high_value"), "finite_count", "max_spacing")


@query(f"WITH {EV}, {DT} {_bucket_sql('floor(sample / 64)', extra='leaf')}")
def overview_events(spark, sf_dir):
    return _flat(overview.build_overview(events(spark, sf_dir), 64))


@query(f"WITH {EV}, {DT} {_bucket_sql('floor(sample / 256)').replace('max(dt)', 'max(CASE WHEN sample % 256 <> 0 THEN dt END)')}")
def overview_merged_events(spark, sf_dir):
    o = overview.build_overview(events(spark, sf_dir), 64)
    return _flat(overview.merge_overview(overview.merge_overview(o)))


@query(f"""WITH {EV}, {DT}, o AS ({_bucket_sql('floor(sample / 64)', extra='leaf')}), p AS (
SELECT channel, bucket, max_spacing, unnest(list_distinct([first_sample, last_sample, low_sample, high_sample])) AS sample FROM o)
SELECT recording_id, channel, bucket, coalesce(max_spacing > 2000, false) AS broken, sample, {R('t')}, {R('value')} FROM p JOIN ev USING (channel, sample)""")
def bucket_points_events(spark, sf_dir):
    return overview.bucket_points(overview.build_overview(events(spark, sf_dir), 64), threshold=2000.0)


VIEW = "least(floor((t - 10000) / 400000.0 * 50), 49)"


@query(f"WITH {EV}, {DT} {_bucket_sql(VIEW, 'WHERE t >= 10000 AND t <= 410000')}")
def view_events(spark, sf_dir):
    return _flat(overview.view(events(spark, sf_dir), 10000.0, 410000.0, 50))


@query(f"WITH {EV}, {DT} SELECT * EXCLUDE max_spacing FROM ({_bucket_sql(VIEW, 'WHERE t >= 10000 AND t <= 410000')})")
def view_from_overview_events(spark, sf_dir):
    ev = events(spark, sf_dir)
    seen = overview.view_of(overview.build_overview(ev, 4), ev, 10000.0, 410000.0, 50, 4)
    return _flat(seen.withColumn("max_spacing", F.lit(None).cast("double"))).drop("max_spacing")


@query(f"WITH {EV} SELECT recording_id, channel, CAST({VIEW} AS BIGINT) AS pixel, {R('min(value)', 'min_value')}, {R('max(value)', 'max_value')} FROM ev WHERE t >= 10000 AND t <= 410000 GROUP BY ALL")
def pixel_range_events(spark, sf_dir):
    return overview.pixel_range(events(spark, sf_dir), 10000.0, 410000.0, 50)


@query(f"""WITH {EV} SELECT recording_id, channel, sample, {R('t')}, {R('value')}, CASE channel WHEN 'view' THEN 1 ELSE 2 END::BIGINT AS rank, {R('((t - 100000.0) * 0.001) ** 2 + ((value - 50) * 0.5) ** 2', 'distance')}
FROM ev WHERE channel IN ('view', 'click') ORDER BY ((t - 100000.0) * 0.001) ** 2 + ((value - 50) * 0.5) ** 2, 6, channel, sample LIMIT 1""")
def nearest_sample_events(spark, sf_dir):
    return overview.nearest_sample(events(spark, sf_dir), 100000.0, 50.0, 0.001, 0.5, ["view", "click"])


@query(f"WITH {EV}, {DT} {_bucket_sql(VIEW, 'WHERE t >= 10000 AND t <= 410000')}")
def view_from_pyramid_events(spark, sf_dir):
    """The view of ``view_events`` from a stored pyramid, opened where a pixel's border needs it."""
    p = build_pyramid(events(spark, sf_dir), Scratch(spark).root, leaf=16, fan=8)
    return _flat(p.view(10000.0, 410000.0, 50))


@query(f"""WITH {EV}, p AS (SELECT s_suppkey, s_suppkey * 7919 % 2600000 + 0.25::DOUBLE AS at_t, CAST(s_acctbal AS DOUBLE) / 50 AS at_value FROM supplier),
d AS (SELECT s_suppkey, channel, sample, t, value * CASE channel WHEN 'click' THEN 2 ELSE 1 END AS value, at_t, at_value FROM p, ev WHERE t >= 5000 AND value IS NOT NULL),
n AS (SELECT *, ((t - at_t) * 0.001) * ((t - at_t) * 0.001) + ((value - at_value) * 0.5) * ((value - at_value) * 0.5) AS distance FROM d)
SELECT 'r' AS recording_id, s_suppkey AS place, channel, sample, {R('t')}, {R('value')}, {R('distance')} FROM n QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY distance, channel, sample) = 1""")
def nearest_samples_supplier(spark, sf_dir):
    """The nearest event, of any type, to a place for each supplier; clicks are shown at twice their value."""
    at_t, at_value = F.col("s_suppkey") * 7919 % 2600000 + 0.25, F.col("s_acctbal").cast("double") / 50
    places = tbl(spark, sf_dir, "supplier").select(F.lit("r").alias("recording_id"), F.col("s_suppkey").alias("place"), at_t.alias("t"), at_value.alias("value"))
    p = build_pyramid(events(spark, sf_dir), Scratch(spark).root, leaf=16, fan=8)
    return p.nearest(places, 0.001, 0.5, affine={"click": (2.0, 0.0)}, start=5000.0).drop("rank", "leaves_read")


# Spectra -----------------------------------------------------------------------------------

def dft_sql(source: str, n: str, dt: str, keep: str = "") -> str:
    """Amplitudes by the defining sums; n and dt are scalars or columns of the source."""
    return f"""{source}, m AS (SELECT *, value - avg(value) OVER (PARTITION BY channel) AS cv, {n} AS nn, {dt} AS dt0 FROM ev {keep}),
sp AS (SELECT recording_id, channel, k.bin, k.bin / (nn * dt0) AS freq, sqrt(sum(cv * cos(2 * pi() * ((k.bin * sample) % nn) / nn)) ** 2 + sum(cv * sin(2 * pi() * ((k.bin * sample) % nn) / nn)) ** 2)
  * CASE WHEN k.bin = 0 OR 2 * k.bin = nn THEN 1 ELSE 2 END / nn AS amp FROM m, range(0, 100000) AS k(bin) WHERE 2 * k.bin <= nn GROUP BY recording_id, channel, k.bin, nn, dt0)"""


# Hours without events are gaps, which the spectrum closes: samples follow each other by the hour.
HOURLY_DFT = dft_sql(f"WITH {HOURS}", "(SELECT count(*) FROM ev)", "3600.0::DOUBLE")
PEAKS = """pk AS (SELECT *, lag(amp) OVER w AS l, lead(amp) OVER w AS r FROM sp WINDOW w AS (PARTITION BY channel ORDER BY bin)),
pr AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY amp DESC, freq) AS rank FROM pk WHERE bin >= 1 AND amp > l AND CASE WHEN r IS NULL THEN amp > 0 ELSE amp >= r END)"""


@query(HOURLY_DFT + f" SELECT recording_id, channel, bin, {R('freq')}, {R('amp')} FROM sp")
def spectrum_hourly_value(spark, sf_dir):
    return spectrum.amplitude_spectrum(hourly(spark, sf_dir))


@query(HOURLY_DFT + f", {PEAKS} SELECT recording_id, channel, CAST(rank AS INT) AS rank, bin, {R('freq')}, {R('amp')} FROM pr WHERE rank <= 3")
def fft_peaks_hourly_value(spark, sf_dir):
    """The three highest peaks of the spectrum of the hourly sums."""
    return spectrum.find_peaks(spectrum.amplitude_spectrum(hourly(spark, sf_dir)), 3)


@query(HOURLY_DFT + f" SELECT recording_id, channel, bin, {R('freq')}, {R('amp')} FROM sp")
def discrete_transform_hourly(spark, sf_dir):
    return spectrum.discrete_transform(spectrum.even_samples(hourly(spark, sf_dir)))


@query(HOURLY_DFT + f" SELECT recording_id, channel, bin, {R('freq')}, {R('amp')} FROM sp")
def spectrum_long_hourly(spark, sf_dir):
    """The hourly spectrum by many tasks of 256 samples at most."""
    return spectrum.amplitude_spectrum(hourly(spark, sf_dir), limit=256)


DFT_WAVES = dft_sql(f"WITH {WAVES}", "64", "0.001")


@query(DFT_WAVES + f" SELECT recording_id, channel, bin, {R('freq')}, {R('amp')} FROM sp")
def spectrum_waveforms(spark, sf_dir):
    return spectrum.amplitude_spectrum(waveforms(spark, sf_dir))


@query(dft_sql(f"WITH {WAVES}", "64", "0.001") + f", {PEAKS} SELECT recording_id, channel, CAST(rank AS INT) AS rank, bin, {R('freq')}, {R('amp')} FROM pr WHERE rank <= 5")
def peaks_waveforms(spark, sf_dir):
    return spectrum.find_peaks(spectrum.amplitude_spectrum(waveforms(spark, sf_dir)), 5)


@query(dft_sql(f"WITH {WAVES}", "33", "0.001", "WHERE sample < 33") + f" SELECT recording_id, channel, bin, {R('freq')}, {R('amp')} FROM sp WHERE freq >= 100 AND freq <= 400")
def spectrum_capped_waveforms(spark, sf_dir):
    return spectrum.bin_range(spectrum.amplitude_spectrum(waveforms(spark, sf_dir), 33), 100.0, 400.0)


EVEN = f"""WITH {EV}, {CADENCE}, {GAPS}, o AS (SELECT *, sum(CASE WHEN dt IS NULL THEN 0 WHEN gap THEN cadence ELSE dt END) OVER (PARTITION BY channel ORDER BY sample ROWS UNBOUNDED PRECEDING) AS off FROM g),
z AS (SELECT channel, count(*) AS nn, max(off) / (count(*) - 1) AS grid FROM o GROUP BY channel),
q AS (SELECT o.*, nn, grid, lead(off) OVER (PARTITION BY o.channel ORDER BY sample) AS off2, lead(value) OVER (PARTITION BY o.channel ORDER BY sample) AS v2 FROM o JOIN z USING (channel)),
e AS (SELECT recording_id, q.channel, k.i AS sample, CASE WHEN k.i = 0 OR off2 IS NULL THEN value ELSE value + (k.i * grid - off) / (off2 - off) * (v2 - value) END AS value, nn, grid
  FROM q JOIN range(0, 30000) AS k(i) ON k.i < nn AND CASE WHEN off2 IS NULL THEN k.i = nn - 1 ELSE k.i < nn - 1 AND k.i * grid >= off AND k.i * grid < off2 END)"""


@query(EVEN + f" SELECT recording_id, channel, sample, {R('value')}, nn AS n, {R('grid')} FROM e", 4)
def even_samples_events(spark, sf_dir):
    """All samples are interpolated, as in the SQL, however near they lie to the even grid."""
    return spectrum.even_samples(events(spark, sf_dir), tolerance=0.0).select("recording_id", "channel", "sample", "value", "n", "grid")


@query(EVEN + f""", m AS (SELECT *, value - avg(value) OVER (PARTITION BY channel) AS cv FROM e),
sp AS (SELECT recording_id, channel, k.bin, nn, grid, sum(cv * cos(2 * pi() * ((k.bin * sample) % nn) / nn)) AS re, sum(cv * sin(2 * pi() * ((k.bin * sample) % nn) / nn)) AS im FROM m JOIN range(0, 20000) AS k(bin) ON 2 * k.bin <= nn GROUP BY ALL)
SELECT recording_id, channel, bin, round(bin / (nn * grid), 9) + 0.0 AS freq, round(CASE WHEN bin = 0 THEN 0 WHEN 2 * bin = nn THEN sqrt(re ** 2 + im ** 2) / nn ELSE 2 * sqrt(re ** 2 + im ** 2) / nn END, 4) + 0.0 AS amp FROM sp""", 9)
def spectrum_long_events(spark, sf_dir):
    """Spectra of all channels of the jittered recording, resampled, by many tasks of 1,024 samples at
    most, or for long channels as many as they need; amplitudes to four places, as resampling sums times in another order than the SQL.
    All samples are interpolated, as there, however near they lie to the even grid."""
    out = spectrum.amplitude_spectrum(events(spark, sf_dir), limit=1024, tolerance=0.0)
    return out.withColumn("amp", F.round("amp", 4))


@query(f"""WITH {BROKEN.replace("ev AS (SELECT * REPLACE (", "ev AS (SELECT * REPLACE (CASE WHEN channel IN ('view', 'click') THEN t ELSE ", 1).replace(" END AS t)", " END END AS t)", 1)}, {DT}
SELECT recording_id, channel, count(*) AS n, CASE WHEN count(value) < 4 THEN 'TooShort' WHEN bool_or(t IS NULL OR dt <= 0) THEN 'InvalidTime' ELSE 'OK' END AS status FROM iv GROUP BY ALL""")
def spectrum_status_broken_times(spark, sf_dir):
    """What a spectrum says of channels with repeated and missing times, and of two without."""
    ev = events(spark, sf_dir)
    good = F.col("channel").isin("view", "click")
    return spectrum.spectrum_status(ev.where(good).unionByName(broken_axis(ev.where(~good))))


ORACLE_SQL["even_samples_events"] = ORACLE_SQL["even_samples_events"].replace(", 6)", ", 4)")


@query(HOURLY_DFT + f""", px AS (SELECT *, CAST(least(floor((freq - 0.00001) / 0.0001 * 20), 19) AS BIGINT) AS pixel FROM sp WHERE freq >= 0.00001 AND freq <= 0.00011),
ch AS (SELECT pixel, unnest(list_distinct([min(bin), max(bin), arg_min(bin, (amp, bin)), arg_max(bin, (amp, -bin))])) AS bin FROM px GROUP BY pixel)
SELECT recording_id, channel, pixel, bin, {R('freq')}, {R('amp')} FROM px JOIN ch USING (pixel, bin)""")
def spectrum_display_hourly(spark, sf_dir):
    return spectrum.display_points(spectrum.amplitude_spectrum(hourly(spark, sf_dir)), 0.00001, 0.00011, 20)


@query(HOURLY_DFT + f" SELECT recording_id, {R('max(amp) * 1.05', 'y_hi')} FROM sp GROUP BY ALL")
def auto_y_spectrum_hourly(spark, sf_dir):
    return stats.auto_y_peak(spectrum.amplitude_spectrum(hourly(spark, sf_dir)), "amp", 1.05)


# Frequency response ------------------------------------------------------------------------

def frf_sql(length: int | None, references: str = "(a + r) / 2", response: str = "n") -> str:
    """Welch sums and the response of column ``response`` to ``references`` for one segment
    length; None: one segment of all samples."""
    size = str(length) if length else "(SELECT count(*) FROM w)"
    hop = f"({length} // 2)" if length else size
    count = f"((SELECT count(*) FROM w) - {size}) // {hop} + 1"
    return f"""WITH {DAYS_WIDE}, {CADENCE.replace('FROM ev)', "FROM (SELECT *, 'x' AS channel FROM w))", 1)}, s AS (SELECT g.s, w.sample - g.s * {hop} AS j, {references} AS x, {response} AS y FROM w JOIN range(0, 20000) AS g(s)
  ON g.s < {count} AND w.sample >= g.s * {hop} AND w.sample < g.s * {hop} + {size}),
h AS (SELECT s, j, (x - avg(x) OVER (PARTITION BY s)) * (0.5 - 0.5 * cos(2 * pi() * j / {size})) AS x, (y - avg(y) OVER (PARTITION BY s)) * (0.5 - 0.5 * cos(2 * pi() * j / {size})) AS y FROM s),
t AS (SELECT s, k.bin, sum(x * cos(2 * pi() * ((k.bin * j) % {size}) / {size})) AS xr, -sum(x * sin(2 * pi() * ((k.bin * j) % {size}) / {size})) AS xi,
  sum(y * cos(2 * pi() * ((k.bin * j) % {size}) / {size})) AS yr, -sum(y * sin(2 * pi() * ((k.bin * j) % {size}) / {size})) AS yi FROM h, range(0, 3000) AS k(bin) WHERE 2 * k.bin <= {size} GROUP BY s, k.bin),
u AS (SELECT bin, sum(xr * xr + xi * xi) AS sxx, sum(yr * yr + yi * yi) AS syy, sum(xr * yr + xi * yi) AS re, sum(xr * yi - xi * yr) AS im, count(*) AS kk FROM t GROUP BY bin),
res AS (SELECT *, bin >= 1 AND sxx > (SELECT max(sxx) FROM u WHERE bin >= 1) * 1e-12 AS valid, bin / ({size} * (SELECT cadence FROM cad)) AS freq FROM u)"""


FRF_ROWS = f"""SELECT 'r' AS recording_id, 'N' AS channel, bin, {R('freq * 1e6', 'micro_hz')}, round(CASE WHEN valid THEN re / sxx END, 6) + 0.0 AS h_re, round(CASE WHEN valid THEN im / sxx END, 6) + 0.0 AS h_im, valid,
round(CASE WHEN valid AND kk >= 2 THEN (re * re + im * im) / (sxx * syy) END, 6) AS coherence, round(CASE WHEN valid THEN sqrt(re * re + im * im) / sxx END, 6) AS dynamic_coefficient,
round(CASE WHEN bin >= 1 THEN CASE WHEN 2 * bin = @L THEN 1 ELSE 2 END * sqrt(sxx / kk) / (0.5 * @L) END, 6) AS reference_amplitude FROM res"""


def _frf(df):
    return df.select("recording_id", "channel", "bin", (F.col("freq") * 1e6).alias("micro_hz"), "h_re", "h_im", "valid", "coherence", "dynamic_coefficient", "reference_amplitude")


@query(frf_sql(64) + " " + FRF_ROWS.replace("@L", "64"))
def frf_h1_daily(spark, sf_dir):
    return _frf(frf.analyze_frf(daily(spark, sf_dir), ["A", "R"], ["N"], frf.FrfOptions(segment_length=64)))


@query(frf_sql(64, "a") + " " + FRF_ROWS.replace("@L", "64"))
def frf_pair_daily(spark, sf_dir):
    return _frf(frf.analyze_pair(daily(spark, sf_dir), "A", "N", frf.FrfOptions(segment_length=64)))


@query(frf_sql(512) + f""", sm AS (SELECT bin, freq, CASE WHEN valid THEN sqrt(re * re + im * im) / sxx END AS kd FROM res WHERE bin >= 1)
SELECT 'r' AS recording_id, 'N' AS channel, bin, {R('kd', 'dynamic_coefficient')}, round(CASE WHEN kd IS NOT NULL THEN avg(kd) OVER (ORDER BY log2(freq) RANGE BETWEEN 0.041666666666666664 PRECEDING AND 0.041666666666666664 FOLLOWING) END, 6) AS smoothed FROM sm""")
def frf_smoothed_daily(spark, sf_dir):
    result = frf.analyze_frf(daily(spark, sf_dir), ["A", "R"], ["N"], frf.FrfOptions(segment_length=512))
    return frf.smooth(result).select("recording_id", "channel", "bin", "dynamic_coefficient", "smoothed")


@query(frf_sql(64) + f" SELECT {R('freq * 1e6', 'micro_hz')}, round(sqrt(re * re + im * im) / sxx, 6) AS dynamic_coefficient, CAST(valid AS INT) AS valid, CAST(1 AS INT) AS response_index, 'N' AS response_name FROM res WHERE bin >= 1")
def frf_rows_daily(spark, sf_dir):
    rows = frf.frf_rows(frf.analyze_frf(daily(spark, sf_dir), ["A", "R"], ["N"], frf.FrfOptions(segment_length=64)))
    return rows.select((F.col("frequency_hz") * 1e6).alias("micro_hz"), "dynamic_coefficient", "valid", "response_index", "response_name")


@query(frf_sql(None) + " " + FRF_ROWS.replace("@L", "(SELECT count(*) FROM w)"), 4)
def frf_direct_daily(spark, sf_dir):
    return _frf(frf.analyze_frf(daily(spark, sf_dir), ["A", "R"], ["N"], frf.FrfOptions(estimator="direct")))


ORACLE_SQL["frf_direct_daily"] = ORACLE_SQL["frf_direct_daily"].replace(", 6)", ", 4)")


def two_recordings(spark, sf_dir):
    """The daily sums as two recordings: whole, and the response halved."""
    long = daily(spark, sf_dir)
    half = long.withColumn("recording_id", F.lit("half")).withColumn("value", F.when(F.col("channel") == "N", F.col("value") / 2).otherwise(F.col("value")))
    return long.unionByName(half)


@query(frf_sql(64) + f", bo AS ({FRF_ROWS.replace('@L', '64')}) SELECT * FROM bo UNION ALL SELECT * REPLACE ('half' AS recording_id, round(h_re / 2, 5) + 0.0 AS h_re, round(h_im / 2, 5) + 0.0 AS h_im, round(dynamic_coefficient / 2, 5) AS dynamic_coefficient) FROM bo", 5)
def frf_two_recordings(spark, sf_dir):
    return _frf(frf.analyze_frf(two_recordings(spark, sf_dir), ["A", "R"], ["N"], frf.FrfOptions(segment_length=64)))


ORACLE_SQL["frf_two_recordings"] = ORACLE_SQL["frf_two_recordings"].replace("round(CASE WHEN valid THEN re / sxx END, 6)", "CASE WHEN valid THEN re / sxx END").replace("round(CASE WHEN valid THEN im / sxx END, 6)", "CASE WHEN valid THEN im / sxx END").replace("round(CASE WHEN valid THEN sqrt(re * re + im * im) / sxx END, 6)", "CASE WHEN valid THEN sqrt(re * re + im * im) / sxx END").replace("SELECT * FROM bo UNION ALL", "SELECT * REPLACE (round(h_re, 5) + 0.0 AS h_re, round(h_im, 5) + 0.0 AS h_im, round(dynamic_coefficient, 5) AS dynamic_coefficient) FROM bo UNION ALL").replace(", 6)", ", 5)")


# Filters -----------------------------------------------------------------------------------

def filter_sql(settings: filters.FilterSettings) -> str:
    """The recurrence, sample by sample, over the hourly sums (which have no resets)."""
    sections, subtract = filters.cascade(settings)
    states, steps, names = [], [], []
    for i, (b0, b1, b2, a1, a2) in enumerate(sections):
        x = "v.value" if i == 0 else f"({names[-1]})"
        y = f"{b0!r} * {x} + f.p{i}"
        names.append(y)
        states += [f"0.0::DOUBLE AS p{i}", f"0.0::DOUBLE AS q{i}"]
        steps += [f"{b1!r} * {x} - {a1!r} * ({y}) + f.q{i}", f"{b2!r} * {x} - {a2!r} * ({y})"]
    out = f"v.value - ({names[-1]})" if subtract else names[-1]
    return f"""WITH RECURSIVE {HOURS}, v AS MATERIALIZED (SELECT sample, value FROM ev), f AS (SELECT -1::BIGINT AS sample, 0.0::DOUBLE AS y, {', '.join(states)}
UNION ALL SELECT v.sample, {out}, {', '.join(steps)} FROM f JOIN v ON v.sample = f.sample + 1)
SELECT recording_id, channel, ev.sample, {R('t')}, {R('f.y', 'value')} FROM f JOIN ev ON ev.sample = f.sample"""


HOUR = 3600.0
FILTERS = {
    f"filter_{family}_{mode}_hourly": filters.FilterSettings(mode, family, 0.02 / HOUR, 0.2 / HOUR, HOUR)
    for family in filters.QUALITY
    for mode in filters.MODES
}


def _filter_query(settings):
    def run(spark, sf_dir):
        return filters.filter_channels(hourly(spark, sf_dir), settings, block=100)

    return run


for _name, _settings in FILTERS.items():
    _run = _filter_query(_settings)
    _run.__name__ = _name
    query(filter_sql(_settings))(_run)


INTERVAL = filters.FilterSettings("bandpass", "linkwitz_riley", 0.02 / HOUR, 0.2 / HOUR, HOUR)


@query(filter_sql(INTERVAL) + f" WHERE ev.t >= {250 * HOUR} AND ev.t <= {500.5 * HOUR}")
def filter_interval_hourly(spark, sf_dir):
    """An interval filtered from the states that a pass over the whole recording has stored."""
    states = FilterStates(Scratch(spark).root, block=100)
    return states.filter_interval(hourly(spark, sf_dir), INTERVAL, sf_dir, 250 * HOUR, 500.5 * HOUR)


# Files -------------------------------------------------------------------------------------

def shared_file(spark, name: str) -> str:
    """A new file's path in the shared folder, which every node sees as a file system."""
    shared = shared_dir(spark)
    if not shared.startswith(("file:/", "/")):
        raise RuntimeError(f"{shared} is not a folder that files can be opened in; single files need a shared file system")
    folder = f"{shared.removeprefix('file://')}/wavemill-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return f"{folder}/{name}"


@query(f"WITH {DAYS_WIDE} SELECT channel, CAST(sample AS BIGINT) AS sample, {R('t')}, {R('value')} FROM (SELECT 'A' AS channel, sample, t, a AS value FROM w UNION ALL SELECT 'N', sample, t, n FROM w) WHERE t >= 86400 * 30 AND t <= 86400 * 900")
def recording_file_round_trip_daily(spark, sf_dir):
    """Written as a comma-separated recording, read back by the data source within a window."""
    path = shared_file(spark, "daily.csv")
    export.write_file(daily(spark, sf_dir), path, ["A", "N"], {"export": {"data_mode": "raw"}})
    long = recording_file.read_recording(spark, path, start=86400.0 * 30, end=86400.0 * 900, checkpoint=500)
    return long.select("channel", "sample", "t", "value")


@query(HOURLY_DFT + f" SELECT channel, bin, {R('amp')} FROM sp")
def stored_spectrum_round_trip_hourly(spark, sf_dir):
    """Amplitudes written to a spectrum file and imported again without a transform."""
    path = shared_file(spark, "spectrum.csv")
    export.write_spectrum_file(spectrum.amplitude_spectrum(hourly(spark, sf_dir)), path, ["hourly"])
    return spectrum.import_spectrum(recording_file.read_recording(spark, path)).select("channel", "bin", "amp")


# Annotations -------------------------------------------------------------------------------

def points(spark, sf_dir):
    o = tbl(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("idx"), F.datediff("o_orderdate", F.lit("1995-01-01")).cast("double").alias("x"), F.sqrt("o_totalprice").alias("y"))


POINTS = "pt AS (SELECT o_custkey AS grp, o_orderkey AS idx, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))::DOUBLE AS x, sqrt(o_totalprice) AS y FROM orders)"


@query(f"""WITH {POINTS}, dl AS (SELECT *, x - lag(x) OVER (PARTITION BY grp ORDER BY idx) AS dx, y - lag(y) OVER (PARTITION BY grp ORDER BY idx) AS dy FROM pt)
SELECT grp, idx, {R('x')}, {R('y')}, {R('dx')}, {R('dy')}, round(CASE WHEN dx <> 0 THEN 1 / dx END, 6) AS inverse_dx, {R('sqrt(dx * dx + dy * dy)', 'length')} FROM dl""")
def point_deltas_orders(spark, sf_dir):
    return annotations.point_deltas(points(spark, sf_dir))


def notes(spark, sf_dir):
    o = tbl(spark, sf_dir, "orders")
    return o.select(F.col("o_orderstatus").alias("mode"), F.col("o_orderpriority").alias("kind"), (F.col("o_custkey") % 9).cast("double").alias("x"), (F.col("o_orderkey") % 7).cast("double").alias("y"))


NOTES = "an AS (SELECT o_orderstatus AS mode, o_orderpriority AS kind, (o_custkey % 9)::DOUBLE AS x, (o_orderkey % 7)::DOUBLE AS y FROM orders)"


@query(f"WITH {NOTES} SELECT DISTINCT mode, kind, {R('x')}, {R('y')} FROM an")
def distinct_annotations_orders(spark, sf_dir):
    return annotations.distinct_annotations(notes(spark, sf_dir))


@query(f"WITH {NOTES} SELECT mode, kind, count(*) AS n FROM an GROUP BY ALL")
def annotation_counts_orders(spark, sf_dir):
    return annotations.annotation_counts(notes(spark, sf_dir))


@query(f"""WITH {POINTS}, nb AS (SELECT *, coalesce(lag(x) OVER w, x) AS x0, coalesce(lag(y) OVER w, y) AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2,
coalesce(lead(x, 2) OVER w, lead(x) OVER w) AS x3, coalesce(lead(y, 2) OVER w, lead(y) OVER w) AS y3 FROM pt WINDOW w AS (PARTITION BY grp ORDER BY idx)),
st AS (SELECT nb.*, s.i AS step, s.i / 8.0 AS u FROM nb, range(0, 8) AS s(i) WHERE x2 IS NOT NULL OR s.i = 0)
SELECT grp, idx, CAST(step AS INT) AS step, {R('CASE WHEN x2 IS NULL THEN x ELSE 0.5 * (2 * x + (x2 - x0) * u + (2 * x0 - 5 * x + 4 * x2 - x3) * u * u + (3 * x - x0 - 3 * x2 + x3) * u * u * u) END', 'x')},
{R('CASE WHEN y2 IS NULL THEN y ELSE 0.5 * (2 * y + (y2 - y0) * u + (2 * y0 - 5 * y + 4 * y2 - y3) * u * u + (3 * y - y0 - 3 * y2 + y3) * u * u * u) END', 'y')} FROM st""", 5)
def spline_orders(spark, sf_dir):
    return annotations.spline(points(spark, sf_dir))


ORACLE_SQL["spline_orders"] = ORACLE_SQL["spline_orders"].replace(", 6)", ", 5)")
