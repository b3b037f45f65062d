import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wavemill.operators import long_spectrum, spectrum
from wavemill.plans import catalog
from wavemill.recording import LONG_SCHEMA, RecordingError

LENGTHS = {"a": 96, "b": 127, "c": 1000, "d": 1009, "e": 2048, "f": 20, "g": 331}


def recording(spark, lengths=LENGTHS, jitter=0.0):
    rng = np.random.default_rng(4)
    rows = []
    for c, n in lengths.items():
        t = np.arange(n) * 0.25
        t[1:-1] += jitter * rng.uniform(-1, 1, n - 2)
        x = np.sin(np.arange(n) * 0.3) + rng.standard_normal(n) + 50
        rows += [("r", c, i, float(t[i]), None if i % 41 == 7 else float(x[i])) for i in range(n)]
    return spark.createDataFrame(rows, LONG_SCHEMA)


@pytest.mark.parametrize("jitter", [0.0, 0.03])
def test_equals_one_task_transform(spark, jitter):
    long = recording(spark, jitter=jitter)
    one = {(r["channel"], r["bin"]): (r["freq"], r["amp"]) for r in spectrum.amplitude_spectrum(long).collect()}
    got = {(r["channel"], r["bin"]): (r["freq"], r["amp"]) for r in spectrum.amplitude_spectrum(long, limit=64).collect()}
    assert got.keys() == one.keys() and len(got) == sum(n // 2 + 1 for n in LENGTHS.values())
    for k, (freq, amp) in one.items():
        assert got[k] == (pytest.approx(freq, rel=1e-12), pytest.approx(amp, abs=1e-11)), k


def test_no_task_is_larger_than_the_limit(spark):
    kinds = set()
    for n in range(65, 1030):
        r, c, g, h, chirp = long_spectrum.plan(n, 64)
        kinds.add(chirp)
        assert (r * c >= 2 * n - 1) if chirp else r * c == n
        assert max(r, c, r * g, c * h) <= 64
    assert kinds == {True, False}
    r, c, g, h, chirp = long_spectrum.plan(2_000_000_011, 1 << 22)  # a prime
    assert chirp and max(r * g, c * h) <= 1 << 22
    with pytest.raises(RecordingError, match="ResourceLimit"):
        long_spectrum.plan(10_007, 64)


def test_channels_too_long_for_the_limit_are_transformed(spark):
    lengths = {"prime": 10_007, "even": 10_000, "fits": 127}
    long = recording(spark, lengths)
    one = spectrum.amplitude_spectrum(long).toPandas().sort_values(["channel", "bin"])
    got = spectrum.amplitude_spectrum(long, limit=64).toPandas().sort_values(["channel", "bin"])
    assert len(got) == sum(n // 2 + 1 for n in lengths.values())
    assert np.array_equal(got[["channel", "bin"]].to_numpy(), one[["channel", "bin"]].to_numpy())
    assert np.allclose(got["freq"], one["freq"], rtol=1e-12, atol=0) and np.abs(got["amp"].to_numpy() - one["amp"].to_numpy()).max() <= 1e-11
    assert [long_spectrum.room(n, 64) for n in (127, 1009, 10_007)] == [64, 64 * 64, 64 * 256]
    for n in (7_178_760, 7_200_011, (1 << 31) - 1):
        most = long_spectrum.room(n, 1024)
        r, c, g, h, _ = long_spectrum.plan(n, most)
        assert max(r * g, c * h) <= most <= 1 << 22
    for n in (20_302, 118_860, 121_812, 500_009, 1_000_000):
        r, c, g, h, _ = long_spectrum.plan(n, long_spectrum.room(n, 1024))
        assert min(g, c) * min(h, r) >= 16, n


def test_chirp_phases_of_large_places():
    n = (1 << 31) + 11
    at = np.array([0, 5, n // 2, n - 1])
    want = [complex(math.cos(math.pi * (k * k % (2 * n)) / n), math.sin(math.pi * (k * k % (2 * n)) / n)) for k in at.tolist()]
    assert np.allclose(long_spectrum._chirp(at, n), want, atol=1e-12)


def test_status(spark):
    t = [float(i) for i in range(8)]
    axes = {
        "good": t, "null": [*t[:3], None, *t[4:]], "nan": [*t[:3], math.nan, *t[4:]], "still": [*t[:3], t[2], *t[4:]],
        "back": [*t[:3], 0.5, *t[4:]], "first": [None, *t[1:]], "infinite": t, "short": t[:3],
    }
    rows = [("r", c, i, x, math.inf if c == "infinite" and i == 2 else float(i % 3)) for c, axis in axes.items() for i, x in enumerate(axis)]
    long = spark.createDataFrame(rows, LONG_SCHEMA)
    status = {r["channel"]: r["status"] for r in spectrum.spectrum_status(long).collect()}
    assert status == {c: "OK" if c == "good" else "InfiniteValues" if c == "infinite" else "TooShort" if c == "short" else "InvalidTime" for c in axes}
    assert {r["channel"] for r in spectrum.amplitude_spectrum(long).select("channel").distinct().collect()} == {"good"}
    assert spectrum.require_spectrum(long).count() == 5
    with pytest.raises(RecordingError, match="InvalidTime"):
        spectrum.require_spectrum(long.where("channel = 'null'"))


def test_rounding_does_not_grow_along_the_axis(spark):
    rng = np.random.default_rng(8)
    wide = rng.random(20_000) < 0.25
    t = np.cumsum(np.where(wide, 200_000_000, rng.integers(20_000_000, 28_000_000, len(wide)))) / 1e6
    rows = pd.DataFrame({"recording_id": "r", "channel": "a", "sample": np.arange(len(t)), "t": t, "value": rng.standard_normal(len(t))})
    dt = np.diff(t, prepend=t[0])
    steps = np.where(dt > 100, np.median(dt[(dt > 0) & (dt < 100)]), dt)
    axis = spectrum.compressed_axis(spark.createDataFrame(rows, LONG_SCHEMA)).orderBy("sample").toPandas()
    assert np.abs(axis["offset"].to_numpy() - np.cumsum(steps.astype(np.longdouble))).max() <= 1e-10


def nearly_even(folder, n=120, scale=1e5):
    """Events whose times lie off an even grid by less than the tolerance of the spectrum."""
    rng = np.random.default_rng(5)
    micros = np.arange(n) * 2_000_000_000 + rng.integers(-700, 700, n)
    micros[[0, -1]] = 0, (n - 1) * 2_000_000_000
    e = pd.DataFrame({"event_id": np.arange(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(micros, unit="us"), "event_type": "view", "value": np.round(scale * rng.random(n), 2)})
    duckdb.sql("SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_type, value FROM e").write_parquet(f"{folder}/events.parquet")


def differing(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    keys = [c for c in ("channel", "sample", "bin") if c in want]
    got = entry.queries()[name](spark, str(folder)).toPandas()[list(want.columns)]
    got, want = got.sort_values(keys), want.sort_values(keys)
    assert np.array_equal(got[keys].to_numpy(), want[keys].to_numpy())
    column = "amp" if "amp" in want else "value"
    return int((np.abs(got[column].to_numpy() - want[column].to_numpy()) > 1e-9).sum())


def test_samples_near_the_grid_equal_the_sql(spark, tmp_path):
    nearly_even(tmp_path)
    long = catalog.events(spark, str(tmp_path))
    assert not spectrum.even_samples(long).first()["resampled"]
    assert spectrum.even_samples(long, tolerance=0.0).first()["resampled"]
    assert differing(spark, tmp_path, "even_samples_events") == 0


@pytest.mark.parametrize("n", [120, 2053])
def test_spectrum_of_samples_near_the_grid_equals_the_sql(spark, tmp_path, n):
    nearly_even(tmp_path, n)
    assert differing(spark, tmp_path, "spectrum_long_events") == 0


def test_every_place_comes_once(spark):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(300):
        t = np.cumsum(np.r_[0, rng.uniform(0.8, 1.2, 48), 0.05 * rng.random()])
        rows += [("r", str(c), i, float(x), float(i % 7)) for i, x in enumerate(t)]
    even = spectrum.even_samples(spark.createDataFrame(rows, LONG_SCHEMA), tolerance=0.0)
    got = even.groupBy("channel").agg(F.count("*").alias("n"), F.countDistinct("sample").alias("places"), F.min("sample").alias("lo"), F.max("sample").alias("hi"))
    assert {tuple(r)[1:] for r in got.collect()} == {(50, 50, 0, 49)}
