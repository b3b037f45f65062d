import zlib

import pytest

from wavemill.llm import language_id as L

WORDS = {"aa": "lorem ipsum dolor sit amet", "bb": "quick brown foxes jump wildly", "cc": "über straße größe mögen fünf"}


def corpus(n=120):
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        w = WORDS[lang].split()
        rows.append((i, " ".join(w[(i * 7 + k * 3) % 5] for k in range(5 + i % 20)), lang, "s"))
    return rows


def test_learns_and_calibrates(docs):
    rows = corpus()
    got = {r["doc_id"]: r for r in L.identify_languages(docs(rows)).collect()}
    assert len(got) == len(rows)
    for i, text, lang, _ in rows:
        assert got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_edge_cases(docs):
    rows = corpus() + [(1000, None, "aa", "s"), (1001, "", "aa", None), (1002, "123 !? \n", None, "s"), (None, "lorem ipsum", None, "s"), (0, corpus()[0][1], "aa", "s"), (1003, "quick brown foxes " * 30_000, None, "s")]
    got = L.identify_languages(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by[None]["lang_pred"] == "aa" and not by[None]["held_out"] and by[1003]["lang_pred"] == "bb"
    kept = L.keep_identified(docs(rows))
    assert kept.columns == docs(rows).columns and {r["doc_id"] for r in kept.collect()} >= {None, 0, 1003} and kept.where("doc_id IN (1000, 1001, 1002)").count() == 0


def test_held_out_rows_teach_nothing(docs):
    rows = [(i, t, lang if zlib.crc32(str(i).encode()) % 5 else "zz", s) for i, t, lang, s in corpus()]
    assert "zz" not in {r["lang_pred"] for r in L.identify_languages(docs(rows)).collect()}


def test_empty_and_unlabelled(docs):
    assert L.identify_languages(docs([])).count() == 0
    assert [tuple(r) for r in L.identify_languages(docs([(1, "some text", None, None)])).collect()] == [(1, False, "und", 0.0)]


def test_blocks_do_not_change_grams():
    import numpy as np

    text = "Größe, the 3 quick foxes! " * 40
    whole = np.sort(np.concatenate(list(L.grams(text))))
    assert (np.sort(np.concatenate(list(L.grams(text, block=17)))) == whole).all()
    slots, counts = L.gram_counts(text)
    assert counts.sum() == len(whole) and (np.repeat(slots, counts) == whole).all()


def test_temperature_finds_the_scale():
    import numpy as np

    rng = np.random.default_rng(0)
    logits = rng.standard_normal((4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    labels = np.array([rng.choice(3, p=q) for q in p])
    assert L.temperature(logits * 4, labels) == pytest.approx(4, rel=0.15)


def literal_predictions(spark, rows, epochs=3, alpha=0.3, beta=1.0, l1=0.002, l2=0.001):
    """The whole method with dictionaries and loops: TF-IDF, proximal updates weight by weight,
    a scan over temperatures, and the softmax of every text."""
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    counts = [Counter(int(s) for g in L.grams(t) for s in g) for _, t, *_ in rows]
    teach = [k for k, (i, t, lang, _) in enumerate(rows) if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 5]
    total = sum(bool(counts[k]) for k in teach)
    df = Counter(s for k in teach for s in counts[k])
    idf = {s: math.log((1 + total) / (1 + df[s])) + 1 for c in counts for s in c}
    ids = spark.createDataFrame([(str(rows[k][0]), k) for k in teach], "i string, k int")
    order = [r["k"] for r in ids.orderBy(F.xxhash64("i")).collect() if counts[r["k"]]]
    langs = sorted({rows[k][2] for k in teach})
    features = [{s: n / sum(c.values()) * idf[s] * L.SCALE for s, n in c.items()} | {"bias": 1.0} if c else {} for c in counts]
    learn, aside, seen = [], [], Counter()
    for k in order:
        seen[rows[k][2]] += 1
        (aside if seen[rows[k][2]] % 5 == 0 else learn).append(k)
    z, n = Counter(), Counter()

    def weight(s, y):
        v = z[s, y]
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n[s, y])) / alpha + l2)

    def softmax(scores):
        e = [math.exp(s - max(scores)) for s in scores]
        return [x / sum(e) for x in e]

    def scores(k):
        return [sum(v * weight(s, y) for s, v in features[k].items()) for y in range(len(langs))]

    for _ in range(epochs):
        for k in learn:
            p, old = softmax(scores(k)), {(s, y): weight(s, y) for s in features[k] for y in range(len(langs))}
            for s, v in features[k].items():
                for y, lang in enumerate(langs):
                    g = v * (p[y] - (lang == rows[k][2]))
                    sigma = (math.sqrt(n[s, y] + g * g) - math.sqrt(n[s, y])) / alpha
                    z[s, y] += g - sigma * old[s, y]
                    n[s, y] += g * g
    held = [(scores(k), langs.index(rows[k][2])) for k in aside]
    loss = lambda t: -sum(math.log(max(softmax([x / t for x in s])[y], 1e-300)) for s, y in held)
    temp = min((math.exp(math.log(0.05) + i / 2000 * math.log(400)) for i in range(2001)), key=loss)
    out = {}
    for k, (i, *_) in enumerate(rows):
        p = softmax([s / temp for s in scores(k)]) if counts[k] else None
        out[i] = (langs[p.index(max(p))], max(p)) if p else ("und", 0.0)
    return out


def test_whole_method_equals_a_literal_one(spark, docs):
    import random

    rng = random.Random(1)
    shared = "alpha beta gamma delta".split()
    rows = []
    for i in range(90):  # languages that share words, so that scores lie between 0 and 1
        lang = sorted(WORDS)[i % 3]
        words = [rng.choice(WORDS[lang].split() if rng.random() < 0.3 else WORDS[sorted(WORDS)[(i + 1) % 3]].split() if rng.random() < 0.3 else shared) for _ in range(6)]
        rows.append((i, " ".join(words), lang, "s"))
    rows += [(500, "12 ?", "aa", "s"), (501, None, "bb", "s"), (502, "alpha", None, "s")]
    expected = literal_predictions(spark, rows)
    for r in L.identify_languages(docs(rows)).collect():
        lang, score = expected[r["doc_id"]]
        assert r["score"] == pytest.approx(score, abs=0.02) and (r["lang_pred"] == lang or abs(score - 0.5) < 0.02)
