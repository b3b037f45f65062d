import pytest
from pyspark.sql import functions as F

from wavemill.plans.catalog_io import streamed
from wavemill.streaming import source


@pytest.mark.parametrize("n, least, length", [(0, 400, 400), (2000, 400, 400), (8001, 400, 1001), (1 << 30, 400, source.LONGEST)])
def test_stretches_grow_with_the_recording(spark, n, least, length):
    rows = spark.createDataFrame([(n - 1,)] if n else [], "sample long")
    assert source.stretch_length(rows, least) == length


@pytest.mark.parametrize("mode", ["update", "complete"])
def test_micro_batches_do_not_multiply_with_samples(spark, monkeypatch, mode):
    lengths, write = [], source.write_stretches
    monkeypatch.setattr(source, "write_stretches", lambda long, folder, stretch: lengths.append(stretch) or write(long, folder, stretch))
    n, x = 4000, F.col("id").cast("double")
    rows = spark.range(n).select(F.lit("r").alias("recording_id"), F.lit("c").alias("channel"), F.col("id").alias("sample"), x.alias("t"), x.alias("value"))
    got = streamed(spark, rows, lambda s: s.groupBy("channel").agg(F.count("*").alias("n")), ("channel",), mode, stretch=100)
    assert [tuple(r) for r in got.collect()] == [("c", n)] and lengths == [n / source.STRETCHES]
