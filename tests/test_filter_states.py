"""Intervals filtered from stored states equal the same samples of a run over everything."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators.filter_states import FilterStates
from wavemill.operators.filters import FilterSettings, filter_channels
from wavemill.plans.recipe import Recipe
from wavemill.recording import LONG_SCHEMA

SETTINGS = FilterSettings("bandpass", "butterworth", 5.0, 40.0, 0.001)


def recording(spark):
    rng = np.random.default_rng(2)
    rows = []
    for name in ("a", "b"):
        t = np.arange(2000) * 0.001
        t[700:] += 0.2  # a gap beyond 64 steps
        x = rng.standard_normal(2000)
        for i in range(2000):
            v = None if i in (128, 900) else math.inf if i == 1300 else float(x[i])
            rows.append(("r", name, i, None if i == 1500 else float(t[i]), v))
    return spark.createDataFrame(rows, LONG_SCHEMA).cache()


def near(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == (None if want[k] is None else pytest.approx(want[k], abs=1e-12))


def values(df):
    return {(r["channel"], r["sample"]): r["value"] for r in df.collect()}


def test_an_interval_equals_the_full_run(spark, tmp_path):
    long, store = recording(spark), FilterStates(f"file://{tmp_path}", 64)
    full = filter_channels(long, SETTINGS, 64).cache()
    assert store.states(long, SETTINGS, "v1").count() == 2 * 32
    for start, end in ((0.3505, 0.36), (0.69, 0.95), (1.69, None), (None, None), (5.0, 6.0)):
        want = full
        if start is not None:
            want = full.where((F.col("t") >= start) & (F.lit(True) if end is None else F.col("t") <= end))
        near(values(store.filter_interval(long, SETTINGS, "v1", start, end)), values(want))


def test_only_the_blocks_of_the_interval_are_read(spark, tmp_path):
    long, store = recording(spark), FilterStates(f"file://{tmp_path}", 64)
    want = values(filter_channels(long, SETTINGS, 64).where("t BETWEEN 0.35 AND 0.36"))
    store.states(long, SETTINGS, "v1")
    # All other blocks are spoilt: the result doesn't notice.
    spoilt = long.withColumn("value", F.when(F.floor(F.col("sample") / 64) == 5, F.col("value")).otherwise(1e300)).cache()
    near(values(store.filter_interval(spoilt, SETTINGS, "v1", 0.35, 0.36)), want)


def test_states_belong_to_their_recipe_and_source(spark, tmp_path):
    store = FilterStates(f"file://{tmp_path}", 64)
    paths = {store.path(SETTINGS, "v1"), store.path(SETTINGS, "v2"), store.path(SETTINGS, "v1", "2*x"), store.path(FilterSettings("bandpass", "bessel", 5.0, 40.0, 0.001), "v1"), FilterStates(f"file://{tmp_path}", 32).path(SETTINGS, "v1")}
    assert len(paths) == 5
    long = recording(spark)
    recipe = Recipe(start=0.5, end=0.6, global_formula="2*x", filter=SETTINGS)
    near(values(recipe.apply(long, store, "v1")), values(recipe.apply(long)))
    passing = FilterSettings("lowpass", "butterworth", step=0.0)
    assert values(store.filter_interval(long, passing, "v1", 0.5, 0.6)) == values(long.where("t BETWEEN 0.5 AND 0.6"))
