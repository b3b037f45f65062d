import numpy as np
import pytest

from wavemill.operators import filters, timeline
from wavemill.recording import LONG_SCHEMA
from wavemill.streaming import stateful


@pytest.fixture
def pieces(spark, tmp_path):
    """A recording of two channels in stretches of 37 samples, a file each."""
    rng = np.random.default_rng(2)
    t = np.arange(200) / 100.0
    t[120:] -= 0.9
    rows = [("r", c, i, float(t[i]), float(v)) for c in "ab" for i, v in enumerate(rng.standard_normal(200))]
    df = spark.createDataFrame(rows, LONG_SCHEMA)
    for k in range(0, 200, 37):
        df.where(f"sample >= {k} AND sample < {k + 37}").coalesce(1).write.parquet(str(tmp_path / "in" / f"s={k:04d}"))
    stream = spark.readStream.schema(LONG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    return df, stream, str(tmp_path / "cp")


def collect(stream, checkpoint, mode="append"):
    q = stream.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(240)
    rows = stream.sparkSession.table("out").collect()
    return rows


def test_filter_stream_equals_batch(pieces):
    df, stream, checkpoint = pieces
    s = filters.FilterSettings("bandpass", "butterworth", 1.0, 20.0, 0.01)
    got = {(r["channel"], r["sample"]): r["value"] for r in collect(stateful.filter_stream(stream, s), checkpoint)}
    for r in filters.filter_channels(df, s).collect():
        assert got[r["channel"], r["sample"]] == pytest.approx(r["value"], abs=1e-12)


def test_monotonic_stream_equals_batch(pieces):
    df, stream, checkpoint = pieces
    got = {(r["channel"], r["sample"]): r["t"] for r in collect(stateful.monotonic_stream(stream), checkpoint)}
    for r in timeline.monotonic_exact(df).collect():
        assert got[r["channel"], r["sample"]] == r["t"]


def test_buckets_and_stats(pieces):
    df, stream, checkpoint = pieces
    rows = collect(stateful.bucket_stream(stream, 64), checkpoint, "complete")
    assert sorted((r["channel"], r["bucket"], r["sample_count"]) for r in rows) == sorted((c, b, 64 if b < 3 else 8) for c in "ab" for b in range(4))
