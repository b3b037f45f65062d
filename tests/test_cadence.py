import numpy as np
import pytest
from pyspark.sql import functions as F

from test_operators import literal_cadence, series
from wavemill.operators import timeline
from wavemill.recording import LONG_SCHEMA


@pytest.mark.parametrize("select,parts", [(5, 2), (1 << 18, 4096)])
def test_selection_equals_the_literal_rule(spark, monkeypatch, select, parts):
    monkeypatch.setattr(timeline, "SELECT", select)
    monkeypatch.setattr(timeline, "PARTS", parts)
    rng = np.random.default_rng(5)
    sets = [
        rng.uniform(0.9, 1.1, 400), np.r_[np.ones(20), np.full(30, 3.0)], np.r_[np.ones(5), np.full(9, 2.0), 40], rng.exponential(1, 300), np.r_[1e-300, np.ones(20)], np.ones(3),
        np.r_[np.ones(4), 1.7, 2.6], np.r_[np.ones(30), 1e6], np.r_[rng.uniform(0.99, 1.01, 50), rng.uniform(1.98, 2.02, 9)], np.array([2.0]), np.r_[1.0, 1.6, 1.7], np.r_[np.full(200, 0.5), 0.5000001],
    ]
    rows = []
    for k, dt in enumerate(sets):
        rows += [("r", str(k), i, float(t), 0.0) for i, t in enumerate(np.r_[0, np.cumsum(rng.permutation(dt))])]
    long = spark.createDataFrame(rows, LONG_SCHEMA)
    got = {r["channel"]: r for r in timeline.cadence(long).collect()}
    for k in range(len(sets)):
        t = np.array([r[3] for r in rows if r[1] == str(k)])
        dt = np.diff(t)
        assert (got[str(k)]["cadence"], got[str(k)]["n_intervals"]) == (literal_cadence(dt[dt > 0].tolist()), (dt > 0).sum()), k


def test_jittered_million(spark, monkeypatch):
    monkeypatch.setattr(timeline, "SELECT", 2000)
    n = 1_000_000
    rows = spark.range(0, n, 1, 8).select(F.lit("r").alias("recording_id"), F.lit("a").alias("channel"), F.col("id").alias("sample"), (F.col("id") * 0.01 + F.pmod(F.xxhash64("id"), F.lit(1000)) * 1e-6).alias("t"), F.lit(0.0).alias("value"))
    t = rows.select("sample", "t").toPandas().sort_values("sample")["t"].to_numpy()
    assert timeline.cadence(rows).first()["cadence"] == float(np.median(np.diff(t)))


def test_no_intervals(spark):
    assert timeline.cadence(series(spark, [1, 1, 0], a=[1, 2, 3])).count() == 0 and timeline.cadence(series(spark, [], a=[])).count() == 0


def test_no_window_over_a_channels_samples(spark, monkeypatch):
    plans, real = [], timeline.settle
    monkeypatch.setattr(timeline, "settle", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    timeline.cadence(series(spark, np.cumsum(np.random.default_rng(0).uniform(1, 2, 99)), a=range(99))).collect()
    windows = [line for p in plans for line in p.splitlines() if "Window [" in line]
    # Lags of samples go by blocks, ranges and parts are few, and what is sorted has SELECT rows at most.
    assert windows and all("__block" in w or "range" in w or "part" in w or "which" in w for w in windows)
