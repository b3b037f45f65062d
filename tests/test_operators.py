import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import formula
from wavemill.operators import filters, frf, overview, spectrum, stats, timeline
from wavemill.recording import LONG_SCHEMA, RecordingError


def series(spark, t, **channels):
    rows = [("r", c, i, float(t[i]), None if x is None or x != x else float(x)) for c, v in channels.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, LONG_SCHEMA)


def amplitudes(df, channel="a"):
    return {r["bin"]: (r["freq"], r["amp"]) for r in df.where(F.col("channel") == channel).collect()}


def test_sine_peak(spark):
    t = np.arange(1000) / 1000
    peak = spectrum.find_peaks(spectrum.amplitude_spectrum(series(spark, t, a=np.sin(2 * np.pi * 50 * t))), 1).first()
    assert abs(peak["freq"] - 50) < 1 and abs(peak["amp"] - 1) < 0.05


def test_highest_bin_is_not_doubled(spark):
    got = amplitudes(spectrum.amplitude_spectrum(series(spark, np.arange(8) / 8, a=[1, -1] * 4)))
    assert got[4] == pytest.approx((4.0, 1.0))


def test_cap_and_short_signals(spark):
    long = series(spark, np.arange(16), a=np.arange(16))
    with pytest.raises(RecordingError):
        spectrum.amplitude_spectrum(long, 3)
    assert len(amplitudes(spectrum.amplitude_spectrum(long, 8))) == 5
    assert spectrum.amplitude_spectrum(series(spark, [0, 1, 2], a=[1, 2, 3])).count() == 0
    assert spectrum.amplitude_spectrum(series(spark, range(8), a=[1, 2, math.inf, 3, 4, 5, 6, 7])).count() == 0


def test_gaps_are_compressed(spark):
    a, b = np.sin(2 * np.pi * 32 * np.arange(128) / 1024), np.sin(2 * np.pi * 128 * np.arange(1024) / 1024)
    x = np.concatenate([a, b])
    t = np.concatenate([np.arange(128) / 1024, 50 + np.arange(1024) / 1024])
    compact = amplitudes(spectrum.amplitude_spectrum(series(spark, np.arange(1152) / 1024, a=x)))
    gapped = spectrum.even_samples(series(spark, t, a=x))
    assert gapped.first()["gaps_ignored"] and not gapped.first()["resampled"]
    got = amplitudes(spectrum.amplitude_spectrum(series(spark, t, a=x)))
    assert all(got[k] == pytest.approx(compact[k], abs=1e-9) for k in compact)


def test_jitter_is_resampled(spark):
    n, rng = 1024, np.random.default_rng(5)
    t = (np.arange(n) + np.where((np.arange(n) > 0) & (np.arange(n) < n - 1), rng.uniform(-0.12, 0.12, n), 0)) / n
    long = series(spark, t, a=np.sin(2 * np.pi * 64 * t))
    assert spectrum.even_samples(long).first()["resampled"]
    assert amplitudes(spectrum.amplitude_spectrum(long))[64][1] == pytest.approx(1, abs=0.06)


def test_missing_values_become_the_mean(spark):
    x = [1.0, 2, None, 4, 5, 6, 7, 8]
    filled = [v if v is not None else sum(w for w in x if w is not None) / 7 for v in x]
    one = amplitudes(spectrum.amplitude_spectrum(series(spark, range(8), a=x)))
    two = amplitudes(spectrum.amplitude_spectrum(series(spark, range(8), a=filled)))
    assert all(one[k] == pytest.approx(two[k]) for k in two)


def test_formulas(spark):
    assert formula.affine(formula.parse("2*x + 3")) == (2, 3)
    assert formula.affine(formula.parse("x*x")) is None and formula.affine(formula.parse("1/x")) is None
    for bad in ("2x", "x 2", "x+()", "1e999", "sin x", "x(2)", "y", "(x"):
        with pytest.raises(formula.FormulaError):
            formula.parse(bad)
    assert formula.parse("") == formula.parse("x")
    for endless in ("1e308*10*x", "x+1e308*10", "sin(1e308*10)", "exp(1e9)", "x/(1e308*10)"):
        assert formula.affine(formula.parse(endless)) is None
    df = spark.createDataFrame([(v,) for v in (-4.0, 0.0, 2.0, None)], "x double")
    assert [r[0] for r in df.select(formula.compose("2*x", "sin(1e308*10)", F.col("x"))).collect()] == [None] * 4
    assert [r[0] for r in df.select(formula.compose("1e200*x", "1e200*x", F.col("x")).alias("y")).collect()] == [-math.inf, 0, math.inf, None]
    got = {f: [r[0] for r in df.select(formula.compile_formula(f, F.col("x"))).collect()] for f in ("1/x", "sqrt(x)", "LOG(x)", "-x*2,5", "-(1/0)")}
    assert got["1/x"] == [-0.25, None, 0.5, None] and got["sqrt(x)"] == pytest.approx([None, 0, math.sqrt(2), None], nan_ok=True)
    assert got["LOG(x)"] == [None, None, math.log(2), None] and got["-x*2,5"] == [10, 0, -5, None] and got["-(1/0)"] == [None] * 4


def literal_cadence(dt):
    dt, n, tried = sorted(dt), len(dt), False
    count = n
    for i in range(2, n):
        r = dt[i] / dt[i - 1]
        if r > 4:
            count = i
            break
        if r > 1.5 and not tried:
            tried, m = True, float(np.median(dt[:i]))
            if all(x / m >= 0.95 and abs(x / m - round(x / m)) <= 0.05 for x in dt):
                count = i
                break
    return float(np.median(dt[:count]))


def test_cadence_equals_the_literal_rule(spark):
    rng = np.random.default_rng(3)
    sets = [rng.uniform(0.9, 1.1, 40), np.r_[np.ones(20), np.full(30, 3.0)], np.r_[np.ones(5), np.full(9, 2.0), 40], rng.exponential(1, 50), np.r_[0.001, np.ones(20)], np.ones(3), np.r_[np.ones(4), 1.7, 2.6], np.r_[np.ones(30), 1e6]]
    rows = []
    for k, dt in enumerate(sets):
        dt = rng.permutation(dt)
        rows += [("r", str(k), i, float(t), 0.0) for i, t in enumerate(np.r_[0, np.cumsum(dt)])]
    got = {r["channel"]: r["cadence"] for r in timeline.cadence(spark.createDataFrame(rows, LONG_SCHEMA)).collect()}
    for k, dt in enumerate(sets):
        assert got[str(k)] == pytest.approx(literal_cadence(dt.tolist()), rel=1e-6), k


def test_blocks_give_the_same_as_one_window(spark):
    from wavemill.operators.blocks import neighbours, running_sum

    long = series(spark, np.arange(50), a=np.arange(50) ** 2, b=-np.arange(50))
    got = {(r["channel"], r["sample"]): (r["p"], r["q"]) for r in neighbours(long, {"p": ("value", -1), "q": ("value", 2)}, block=7).collect()}
    assert len(got) == 100 and got["a", 14] == (13**2, 16**2) and got["a", 0] == (None, 4) and got["b", 49] == (-48, None)
    total = {(r["channel"], r["sample"]): r["s"] for r in running_sum(long, {"s": F.col("value")}, block=7).collect()}
    assert total["a", 49] == sum(i * i for i in range(50)) and total["b", 20] == -210


@pytest.mark.parametrize("times", [[0, 0.1, 0.1, 0.2], [0, 0.1, 0.05, 0.15], [0, 1, 2, 0, 1, 2, 0, 5]])
def test_monotonic(spark, times):
    long = series(spark, times, a=times)
    one, two = ([r["t"] for r in f(long).orderBy("sample").collect()] for f in (timeline.monotonic, timeline.monotonic_exact))
    assert all(a < b for a, b in zip(two, two[1:])) and one == pytest.approx(two)


def test_gap_estimates():
    assert timeline.step_for_missing(0.131, 3) == pytest.approx(0.03275)
    assert timeline.blended_step(5, 1, 4) == 1 and timeline.blended_step(9, 1, 99) == 1 and timeline.blended_step(6, 1, 99) == 4


def test_gaps_and_ranges(spark):
    long = series(spark, [0, 1, 2, 6, 7, 8], a=range(6))
    g = timeline.gaps(long).collect()
    assert [(r["left"], r["right"], r["missing"]) for r in g] == [(2, 6, 3)]
    assert timeline.gaps(long, start=7.0).count() == 0 and timeline.gaps(long, start=6.0).count() == 1
    r = stats.sample_range(series(spark, [0, 0.1, 0.2, 0.3, 0.4], a=range(5)), 0.15, 0.35).first()
    assert (r["first"], r["past"]) == (2, 4)
    with pytest.raises(RecordingError):
        stats.resolve_range(long, -1, 3)
    assert stats.resolve_range(long, -1, 3, clamp=True) == (0, 3)


def literal_filter(settings, t, x):
    sections, subtract = filters.cascade(settings)
    out, state, before = [], [0.0] * (2 * len(sections)), None
    for now, v in zip(t, x):
        if v is None or not math.isfinite(v) or not math.isfinite(now):
            out.append(v)
            state, before = [0.0] * len(state), None
            continue
        if before is not None and not 0 < now - before <= 64 * settings.step:
            state = [0.0] * len(state)
        before = now
        y = filters.run_sections(sections, np.array([v]), state)[0] if sections else v
        out.append(v - y if subtract else y)
    return out


@pytest.mark.parametrize("family", filters.QUALITY)
@pytest.mark.parametrize("mode", filters.MODES)
def test_filter_blocks_equal_the_recurrence(spark, family, mode):
    rng = np.random.default_rng(1)
    t = np.arange(700) / 1024
    t[300:] += 1.0
    x = rng.standard_normal(700).tolist()
    x[450] = None
    s = filters.FilterSettings(mode, family, 10, 100, 1 / 1024)
    got = [r["value"] for r in filters.filter_channels(series(spark, t, a=x), s, block=97).orderBy("sample").collect()]
    expected = literal_filter(s, t, x)
    assert got[450] is None and [g for g in got if g is not None] == pytest.approx([e for e in expected if e is not None], abs=1e-11)


def test_unset_filter_changes_nothing(spark):
    long = series(spark, np.arange(10), a=np.arange(10))
    s = filters.FilterSettings("highpass", step=1.0)
    assert filters.filter_channels(long, s).collect() == long.collect()


def test_h1(spark):
    i = np.arange(4096)
    x, y = np.sin(2 * np.pi * 13 * i / 256), 2 * np.sin(2 * np.pi * 13 * i / 256 + 0.7)
    long = series(spark, i / 1024, x=x, y=y, z=0 * x, flat=0 * x + 3)
    rows = {r["bin"]: r for r in frf.analyze_pair(long, "x", "y", frf.FrfOptions(segment_length=256)).collect()}
    r = rows[13]
    assert r["freq"] == pytest.approx(52) and r["dynamic_coefficient"] == pytest.approx(2) and math.atan2(r["h_im"], r["h_re"]) == pytest.approx(0.7)
    assert r["coherence"] == pytest.approx(1) and r["reference_amplitude"] == pytest.approx(1) and not rows[100]["valid"] and not rows[0]["valid"]
    assert frf.plan(4096, frf.FrfOptions()) == (1024, 512, 7) and frf.plan(4096, frf.FrfOptions(segment_length=256)) == (256, 128, 31)
    zero = {r["bin"]: r for r in frf.analyze_pair(long, "x", "z", frf.FrfOptions(segment_length=256)).collect()}[13]
    assert zero["valid"] and zero["dynamic_coefficient"] == 0 and not zero["coherence_valid"]
    with pytest.raises(RecordingError, match="WeakReference"):
        frf.require_reference(frf.analyze_pair(long, "flat", "y", frf.FrfOptions(segment_length=256)))
    for roles in ((["x"], ["x"]), ([], ["y"]), (["x", "x"], ["y"])):
        with pytest.raises(RecordingError, match="InvalidChannels"):
            frf.analyze_frf(long, *roles)
    for o in (frf.FrfOptions(segment_length=255), frf.FrfOptions(threshold=0)):
        with pytest.raises(RecordingError, match="InvalidOptions"):
            frf.analyze_pair(long, "x", "y", o)


def test_references_are_averaged_and_gaps_ignored(spark):
    i = np.arange(1024)
    x = np.sin(2 * np.pi * 13 * i / 256)
    t = i / 1024 + (i >= 512) * 1e6
    long = series(spark, t, a=x, b=3 * x, c=-x, y=6 * x)
    got = frf.analyze_frf(long, ["a", "b"], ["y"], frf.FrfOptions(segment_length=256)).where("bin = 13").first()
    assert got["dynamic_coefficient"] == pytest.approx(3) and frf.has_gaps(long)
    with pytest.raises(RecordingError, match="WeakReference"):
        frf.require_reference(frf.analyze_frf(long, ["a", "c"], ["y"], frf.FrfOptions(segment_length=256)))


def test_noise_coherence(spark):
    rng = np.random.default_rng(1731)
    x = rng.standard_normal(65536)
    long = series(spark, np.arange(65536), x=x, y=2 * x + rng.standard_normal(65536))
    r = frf.analyze_pair(long, "x", "y", frf.FrfOptions(segment_length=1024)).where("coherence_valid").agg(F.avg("coherence"), F.count("*")).first()
    assert 0.75 < r[0] < 0.85 and r[1] == 512


def test_nearest_sample_and_overview_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    t, x = np.cumsum(rng.uniform(0.5, 1.5, 300)), rng.standard_normal(300)
    x[17] = math.nan
    long = series(spark, t, a=x, b=x[::-1])
    got = overview.nearest_sample(long, 100.0, 0.3, 0.1, 2.0, ["b", "a"]).first()
    brute = min((((ti - 100) * 0.1) ** 2 + ((v - 0.3) * 2) ** 2, rank, i) for rank, c in enumerate((x[::-1], x)) for i, (ti, v) in enumerate(zip(t, c)) if v == v)
    assert (got["distance"], got["sample"]) == pytest.approx((brute[0], brute[2]))
    o = overview.build_overview(long, 16)
    merged = {(r["channel"], r["bucket"]): r.asDict(recursive=True) for r in overview.merge_overview(o).collect()}
    direct = {(r["channel"], r["bucket"]): r.asDict(recursive=True) for r in overview.build_overview(long, 32).collect()}
    assert merged.keys() == direct.keys()
    for k in direct:
        assert {f: merged[k][f] for f in ("first", "last", "low", "high", "finite_count", "sample_count")} == {f: direct[k][f] for f in ("first", "last", "low", "high", "finite_count", "sample_count")}
    ties = overview.build_overview(series(spark, range(6), a=[1, 3, 3, 0, 0, 2])).first()
    assert ties["low"]["sample"] == 3 and ties["high"]["sample"] == 1


def test_views():
    from wavemill.operators.view import View

    v = View(0.0, 100.0, 0.0, 100.0, 1.0)
    z = v.zoom(0.5, 0.25)
    assert (z.start, z.end) == (12.5, 62.5) and (z.zoom(4).start, z.zoom(4).end) == (0.0, 100.0)
    assert (z.pan(-1).start, z.pan(-1).end) == (0.0, 50.0) and (z.pan(2).start, z.pan(2).end) == (50.0, 100.0)
    tiny = z.zoom(1e-9, 1.0)
    assert tiny.end == pytest.approx(62.5) and tiny.end - tiny.start == pytest.approx(1.0)
    assert View(-5.0, 2.0, 0.0, 4.0).clamped() == View(0.0, 4.0, 0.0, 4.0)


def test_repeated_and_missing_times(spark):
    from wavemill.operators import timeline

    long = series(spark, [0, 0, 1, 2, 3, 4], a=range(6))
    assert timeline.cadence(long).first()["cadence"] == 1 and timeline.timeline_report(long).first()["status"] == "InvalidTime"
    assert timeline.gaps(long).count() == 0 and timeline.segments(long).count() == 1 and timeline.stitched(long).count() == 6
    assert spectrum.amplitude_spectrum(long).count() == 0
    rows = [("r", "a", i, t, 0.0) for i, t in enumerate([0.0, 1.0, None, 0.5, 1.5])]
    broken = spark.createDataFrame(rows, long.schema)
    for f in (timeline.monotonic, timeline.monotonic_exact):
        assert [r["t"] for r in f(broken).orderBy("sample").collect()] == [0, 1, None, 2, 3]


def test_recordings_are_analysed_each_by_itself(spark):
    i = np.arange(512)
    x = np.sin(2 * np.pi * 13 * i / 64)
    good = series(spark, i / 1024, x=x, y=3 * x, z=x)
    half = series(spark, i[:256] / 512, x=x[:256], y=5 * x[:256], z=[None, *x[1:256]]).withColumn("recording_id", F.lit("half"))
    bad = series(spark, i[:64] * 0.0, x=x[:64], y=x[:64], z=x[:64]).withColumn("recording_id", F.lit("still"))
    short = series(spark, i[:3], x=x[:3], y=x[:3], z=x[:3]).withColumn("recording_id", F.lit("short"))
    huge = series(spark, i[:64], x=np.full(64, 1e308) * (-1) ** i[:64], y=x[:64], z=x[:64]).withColumn("recording_id", F.lit("huge"))
    long = good.unionByName(half).unionByName(bad).unionByName(short)
    status = {(r["recording_id"], r["channel"]): r["status"] for r in frf.frf_status(long, ["x"], ["y", "z"]).collect()}
    assert status["r", "y"] == status["r", "z"] == status["half", "y"] == "None" and status["half", "z"] == "MissingValues"
    assert status["still", "y"] == "InvalidTime" and status["short", "z"] == "TooShort"
    got = {(r["recording_id"], r["channel"]): r["dynamic_coefficient"] for r in frf.analyze_frf(long, ["x"], ["y", "z"], frf.FrfOptions(segment_length=64)).where("bin = 13").collect()}
    assert got == {("r", "y"): pytest.approx(3), ("r", "z"): pytest.approx(1), ("half", "y"): pytest.approx(5)}
    with pytest.raises(RecordingError, match="InvalidTime"):
        frf.analyze_frf(bad, ["x"], ["y"])
    with pytest.raises(RecordingError, match="Overflow"):
        frf.require_reference(frf.analyze_frf(huge, ["x"], ["y"], frf.FrfOptions(segment_length=64)))


def test_ranges_number_samples_as_one_sort_does(spark):
    from wavemill.recording import from_rows

    rng = np.random.default_rng(6)
    rows = [(int(k), float(v), "ab"[i % 2]) for i, (k, v) in enumerate(zip(rng.integers(0, 50, 500) ** 2, rng.standard_normal(500)))]
    df = spark.createDataFrame(rows, "k long, v double, c string")
    args = (F.col("k"), F.col("v"), F.col("c"), [F.col("k"), F.col("v")])
    one, cut = from_rows(df, *args), from_rows(df, *args, block=40)
    assert sorted(one.collect()) == sorted(cut.collect())


def test_progress_and_cancellation(spark):
    import threading
    import time

    from wavemill.streaming.progress import tracked

    with tracked(spark) as p:
        assert spark.range(1000).repartition(3).count() == 1000
        assert 0 < p.counts()["done"] <= p.counts()["tasks"] and p.counts()["active"] == 0

        def stop():
            while not p.counts()["active"]:
                time.sleep(0.05)
            p.cancel()

        threading.Thread(target=stop).start()
        with pytest.raises(Exception, match="cancel"):
            spark.range(8).repartition(8).mapInArrow(lambda bs: (time.sleep(20), bs)[1], "id long").collect()


def test_stored_sampling():
    lines = ["[export]", "sample_dt=9", "[fft_sampling]", "source_start=1.5", "sample_dt=-1", "sample_count=12", "resampled=1", "gaps_ignored=0", "x=1", "source_end=nan"]
    assert spectrum.stored_sampling(lines) == {"source_start": 1.5, "sample_count": 12, "resampled": True, "gaps_ignored": False}


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_exact_times_by_blocks(spark, block):
    rng = np.random.default_rng(8)
    axes = {
        "steps": np.cumsum(rng.choice([0.1, 0.1, 0.3, 0.0, -0.5], 200)), "tens": np.tile(np.arange(10) * 0.1, 20), "still": np.zeros(30), "falls": -np.arange(40.0),
        "holes": np.where(rng.random(100) < 0.4, np.nan, np.cumsum(rng.choice([1.0, -2.0, 0.7], 100))), "none": np.full(20, np.nan), "fine": 1e9 + np.arange(60) * 2.0**-23,
        "jump": np.r_[np.arange(30.0), 1e17, np.arange(30.0)],
    }
    rows = [("r", c, i, None if x != x else float(x), 0.0) for c, t in axes.items() for i, x in enumerate(t.tolist())]
    got = timeline.monotonic_exact(spark.createDataFrame(rows, LONG_SCHEMA).repartition(5), block).orderBy("channel", "sample").collect()
    found = {}
    for r in got:
        found.setdefault(r["channel"], []).append(math.nan if r["t"] is None else r["t"])
    for c, t in axes.items():
        assert np.array_equal(found[c], timeline.advance(t), equal_nan=True), c
