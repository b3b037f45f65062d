import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wavemill.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, left = sum(sizes.values()), {}, set(names)
    while True:
        rest = total - sum(out.values())
        over = {s for s in left if rest * w[s] / sum(w[x] for x in left) > cap * sizes[s]}
        if not over:
            return out | {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        out |= {s: cap * sizes[s] for s in over}
        left -= over


def rows_of():
    rows = [(i, "w " * (1 + (i * 37) % 90), "en", f"s{i % 5}") for i in range(300)]
    rows += [(1000 + i, "same text here", "en", "hot") for i in range(700)]
    rows += [(2000, None, "en", "s1"), (2001, "", "en", None), (2002, "a\x0bb c d", "en", None), (None, "x y z", "en", "é"), (3, "w " * 22, "en", "s3"), (3, "w " * 22, "en", "s3"), (4000, "long " * 20000, "en", "s2")]
    return rows


def test_mix_meets_its_targets(docs):
    rows = rows_of()
    got = mixing.mix_sources(docs(rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    source = defaultdict(list)
    for i, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = brute_targets(dict(sizes))
    of = {(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))): s for i, t, _, s in rows}
    for r in got:
        s = of[r["doc_id"], r["size"]]
        source[s].append(r)
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s], rel=1e-9, abs=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    for s in source:
        shortest = min((r["size"] for r in source[s] if r["size"]), default=0)
        # One document of s2 is longer than its target and all others together can make up for.
        assert abs(taken[s] - target[s]) <= (6000 if s == "s2" else max(shortest, 1)), (s, taken[s], target[s])


def test_reruns_agree(docs):
    d = docs(rows_of())
    key = lambda r: tuple((v is None, v) for v in (r["doc_id"], r["size"], r["taken"]))
    one, two = sorted(map(key, mixing.mix_sources(d).collect())), sorted(map(key, mixing.mix_sources(d.repartition(13)).collect()))
    assert one == two


def test_rates_are_exponential_tilts(docs):
    got = mixing.mix_sources(docs(rows_of())).where("source_size > 0 AND size > 0 AND rate BETWEEN 0.001 AND 2.99")
    # log odds of a source are linear in size through the odds of rate 1
    for r in got.withColumn("tilt", (F.log(F.col("rate") / (3 - F.col("rate"))) + math.log(2)) / F.col("size")).groupBy("source_size", "target").agg(F.max("tilt").alias("hi"), F.min("tilt").alias("lo")).collect():
        assert r["hi"] == pytest.approx(r["lo"], rel=1e-6, abs=1e-9)


def test_apply_repeats_rows(docs):
    d = docs(rows_of())
    out = mixing.apply_mix(d)
    assert out.columns == d.columns
    assert out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == mixing.mix_sources(d).agg(F.sum("taken")).first()[0]


def test_empty(docs):
    assert mixing.mix_sources(docs([])).count() == 0
    assert [r["taken"] for r in mixing.mix_sources(docs([(1, None, None, None), (2, "", None, "a")])).collect()] == [0, 0]


def test_native(docs):
    plan = mixing.mix_sources(docs(rows_of()[:20]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
