"""Views and nearest samples from a stored pyramid, against the samples themselves."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import frf, overview
from wavemill.operators.pyramid import Pyramid, _ranges, build_pyramid
from wavemill.recording import LONG_SCHEMA, RecordingError

PLACES = "recording_id string, place long, t double, value double"


def recording(spark, n=3000, seed=5, shuffle=False):
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.uniform(0.5, 1.5, n))
    if shuffle:
        t = rng.permutation(t)
    rows = []
    for name in ("a", "b"):
        x = np.cumsum(rng.standard_normal(n))
        for i in range(n):
            v = None if i % 97 == 3 else math.inf if i % 501 == 7 else float(x[i])
            rows.append(("r", name, i, None if shuffle and i % 40 == 1 else float(t[i]), v))
    rows.append(("s", "a", 0, 5.0, 1.0))
    return spark.createDataFrame(rows, LONG_SCHEMA), rows


def brute(rows, t, value, channels=("a", "b"), affine=None, low=-math.inf, high=math.inf, ts=1.0, vs=1.0):
    best = None
    for _, c, i, at, v in (r for r in rows if r[0] == "r" and r[1] in channels):
        if at is None or v is None or not math.isfinite(v) or not low <= at <= high:
            continue
        a, b = (affine or {}).get(c, (1.0, 0.0))
        dx, dy = (at - t) * ts, (v * a + b - value) * vs
        key = (dx * dx + dy * dy, channels.index(c), i, c)
        best = key if best is None or key < best else best
    return best


@pytest.fixture(scope="module", params=[False, True], ids=["increasing", "shuffled"])
def made(request, spark, tmp_path_factory):
    long, rows = recording(spark, shuffle=request.param)
    return long.cache(), rows, build_pyramid(long, f"file://{tmp_path_factory.mktemp('pyramid')}/p", leaf=16, fan=8), request.param


def test_view_equals_the_one_from_samples(made):
    long, _, p, shuffle = made
    assert p.top == 3  # 188 leaves, 24, 3, 1
    for start, end, pixels in ((-5.0, 4000.0, 7), (100.5, 900.25, 40)):
        key = lambda r: (r["recording_id"], r["channel"], r["bucket"])
        want = sorted((r.asDict(recursive=True) for r in overview.view(long, start, end, pixels).collect()), key=key)
        got = sorted((r.asDict(recursive=True) for r in p.view(start, end, pixels).collect()), key=key)
        assert got == want
        if not shuffle:
            leaves = p.view_parts(start, end, pixels)[1].groupBy("recording_id", "channel").count().agg(F.max("count")).first()[0]
            assert (leaves or 0) <= pixels + 1
    only = p.view(5000.0, 6000.0, 3, ["b"]).unionByName(p.view(100.5, 900.25, 4, ["b"]))
    assert [tuple(r) for r in only.groupBy("channel").count().collect()] == [("b", 4)]
    plan = p.view(100.5, 900.25, 4)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(bucket" in plan


def test_nearest_equals_brute_force_and_leaves_are_pruned(spark, made):
    _, rows, p, shuffle = made
    rng = np.random.default_rng(8)
    asked = [("r", i, float(rng.uniform(-100, 3300)), float(rng.uniform(-80, 80))) for i in range(30)]
    bad = [("r", 90, None, 1.0), ("r", 91, math.nan, 1.0), ("r", 92, 1.0, math.inf), ("none", 93, 1.0, 1.0)]
    places = spark.createDataFrame([*asked, asked[0], *bad], PLACES)
    for options in ({}, {"channels": ("b", "a"), "affine": {"a": (-2.0, 3.0)}, "start": 200.0, "end": 2500.5}):
        got = {r["place"]: r for r in p.nearest(places, 0.01, 0.5, **options).collect()}
        assert sorted(got) == list(range(30))
        for _, i, t, v in asked:
            order = {"channels": options["channels"]} if "channels" in options else {}
            d, _, sample, channel = brute(rows, t, v, affine=options.get("affine"), low=options.get("start", -math.inf), high=options.get("end", math.inf), ts=0.01, vs=0.5, **order)
            assert (got[i]["distance"], got[i]["sample"], got[i]["channel"]) == (d, sample, channel)
        if not shuffle:
            assert np.mean([r["leaves_read"] for r in got.values()]) < 0.15 * 2 * 188


def test_nearest_breaks_ties_by_the_order_of_channels(spark, tmp_path):
    rows = [("r", c, i, float(i), 1.0) for c in ("a", "b") for i in range(100)]
    p = build_pyramid(spark.createDataFrame(rows, LONG_SCHEMA), f"file://{tmp_path}/p", leaf=4, fan=8)
    places = spark.createDataFrame([("r", 1, 50.5, 9.0)], PLACES)
    got = p.nearest(places, channels=["b", "a"]).first()
    assert (got["channel"], got["sample"], got["rank"]) == ("b", 50, 1)
    assert p.nearest(places).first()["channel"] == "a" and p.nearest(places, channels=["c"]).count() == 0
    with pytest.raises(RecordingError):
        p.nearest(places, t_scale=0.0)


def test_copies_of_a_point_are_not_all_read(spark, tmp_path):
    """Of 64 copies of each point (16 leaves) the first is the nearest, and only its leaf need be read."""
    rows = [("r", c, 64 * i + k, float(i), float(i * 37 % 11)) for c in ("a", "b") for i in range(40) for k in range(64)]
    p = build_pyramid(spark.createDataFrame(rows, LONG_SCHEMA), f"file://{tmp_path}/p", leaf=4, fan=8)
    asked = [("r", i, 4.5 * i + 0.1, float(i)) for i in range(8)]
    for r in p.nearest(spark.createDataFrame(asked, PLACES), 2.0, 1.0, channels=["b", "a"]).collect():
        _, _, t, v = asked[r["place"]]
        nearest = min((((x[3] - t) * 2.0) ** 2 + (x[4] - v) ** 2, x[1] == "a", x[2]) for x in rows)
        assert (r["distance"], r["channel"] == "a", r["sample"]) == nearest
        assert r["leaves_read"] <= 4


def test_pyramid_is_reopened_and_knows_its_source(spark, tmp_path):
    long, _ = recording(spark, n=50)
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    with pytest.raises(RecordingError):
        Pyramid(spark, path)
    build_pyramid(long, path, 8, 4, "first")
    assert build_pyramid(long.limit(0), path, 8, 4, "first").boxes(0).count() == 15  # not made again
    with pytest.raises(RecordingError):
        Pyramid(spark, path, "second")
    empty = build_pyramid(long.limit(0), f"{path}-empty", 8, 4)
    assert empty.view(0.0, 1.0, 4).count() == 0 and empty.nearest(spark.createDataFrame([("r", 1, 0.0, 0.0)], PLACES)).count() == 0


def test_ranges_are_cut_at_the_widest_gaps():
    assert _ranges([9, 1, 2, 3, 20, 21], 2) == [(1, 9), (20, 21)] and _ranges([4]) == [(4, 4)] and _ranges([1, 2, 3]) == [(1, 3)]


def test_smoothing_equals_the_literal_mean(spark):
    rng = np.random.default_rng(3)
    values = rng.uniform(0, 5, 700)
    rows = [("r", c, k, k * 0.25, None if (k * 7 + s) % 31 == 0 else float(values[k] + s)) for s, c in enumerate("ab") for k in range(700)]
    result = spark.createDataFrame(rows, "recording_id string, channel string, bin long, freq double, dynamic_coefficient double")
    for octaves in (1 / 12, 2.0):
        got = {(r["channel"], r["bin"]): r["smoothed"] for r in frf.smooth(result, octaves).collect()}
        assert len(got) == 2 * 699
        span = 2 ** (octaves / 2)
        for c in "ab":
            own = {r[2]: r[4] for r in rows if r[1] == c}
            for k in range(1, 700):
                near = [own[j] for j in range(math.ceil(k / span), min(math.floor(k * span), 699) + 1) if own[j] is not None]
                assert got[c, k] == (None if own[k] is None else pytest.approx(np.mean(near), rel=1e-10))
    plan = frf.smooth(result)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
