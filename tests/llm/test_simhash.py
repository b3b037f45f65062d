import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from wavemill.llm import simhash
from wavemill.scratch import Scratch


def brute_fingerprint(text):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, threshold=2):
    own = list(range(len(fps)))
    def root(x):
        while own[x] != x:
            x = own[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= threshold:
                own[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def corpus():
    base = [" ".join(f"t{(i * 31 + k * k * 7) % 997}" for k in range(150 + i)) for i in range(20)]
    rows = [(i, t, "en", "s") for i, t in enumerate(base)]
    for i in range(120):
        words = base[i % 4].split()
        words[i % len(words)] = "CHANGED"
        rows.append((100 + i, " ".join(words), "en", "s"))
    return rows + [(300 + i, base[0].upper(), "en", "s") for i in range(50)] + [(500, None, "en", "s"), (501, "", "en", "s"), (502, " \n\t", "en", "s"), (503, "one", "en", "s"), (504, "One", "en", "s"), (505, "two words", "en", "s"), (506, "w " * 40_000, "en", "s"), (506, "w " * 40_000, "en", "s"), (507, " x", "en", "s")]


def test_equals_brute_force(docs):
    rows = corpus()
    got = simhash.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    comps = brute_components(fps)
    for (i, *_), fp, c in zip(rows, fps, comps):
        assert by[i]["fingerprint"] == f"{fp:016x}"
        assert by[i]["component_id"] == min(r[0] for r, d in zip(rows, comps) if d == c)


def test_links_connect_all_within_reach(spark):
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))) for c in centre for _ in range(30)} | {0, (1 << 64) - 1, 1, 3, 7}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for tile in (4096, 5):  # 5: every bucket is cut into blocks
        own = {f: f for f in fps}
        def root(x):
            while own[x] != x:
                x = own[x]
            return x
        for r in simhash.fingerprint_links(df, Scratch(spark), 2, tile).collect():
            u, v = r["u"] % (1 << 64), r["v"] % (1 << 64)
            assert bin(u ^ v).count("1") <= 2
            own[root(u)] = root(v)
        comps = brute_components(fps)
        assert len({root(f) for f in fps}) == len(set(comps))


def test_chain_is_one_component(docs, spark):
    from wavemill.llm.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 500), (-3, 200), (200, -3)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges, Scratch(spark)).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[200] == -3 and 500 not in got


def brute_survivors(rows):
    """The ids that stay, by comparing all pairs of sets of five-word shingles."""
    sets = []
    for _, text, *_ in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    own = list(range(len(rows)))

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                own[root(i)] = root(j)
    return {min(r[0] for k, r in enumerate(rows) if root(k) == g) for g in {root(k) for k in range(len(rows))}}


def planted():
    """Texts with copies in which 0 to 8 words are changed: similarities on both sides of 0.8."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for i in range(40):
        base = [word() for _ in range(rng.choice([30, 80, 200, 400]))]
        rows.append((100 * i, " ".join(base), "en", "s"))
        for k in range(9):
            copy = list(base)
            for at in rng.sample(range(len(copy)), k):
                copy[at] = word()
            rows.append((100 * i + 1 + k, " ".join(copy), "en", "s"))
    return rows + [(9000, None, "en", "s"), (9001, " \n", "en", "s"), (9002, "One two", "en", "s"), (9003, "one  TWO", "en", "s"), (9004, "two one", "en", "s")]


def test_wide_fingerprints_equal_votes():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 5, 70_000, 3, 150_000, 2)]
    got = simhash.wide_fingerprints(sets, 2)
    for s, row in zip(sets, got):
        for w in range(2):
            h = simhash._mix(s + np.uint64((w + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            assert int(row[w]) == sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(s))


def test_pivot_tables_hold_distances_and_bound_them():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, (200, 4), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (200, 4), dtype=np.uint64)
    table = simhash.coordinates(x)
    for i, p in enumerate(simhash.PIVOTS[1:]):
        ones = np.bitwise_count(table >> np.uint64(2 * i) & np.uint64(3)).astype(int)
        assert (2 * ones == np.bitwise_count(x).astype(int) - np.bitwise_count(x ^ np.uint64(p)) + 2).all()
    apart = np.bitwise_count(table[:100] ^ table[100:]).sum(1)
    assert (apart <= np.bitwise_count(x[:100] ^ x[100:]).sum(1)).all()


def test_near_keys_and_discards_come_from_the_pivot_table(spark):
    """Fingerprints that swap the bits of every pivot have the same coordinates: the same keys,
    and only their own distance tells them apart."""
    five, ten = np.uint64(0x5555555555555555), np.uint64(0xAAAAAAAAAAAAAAAA)
    x = np.array([[five] * 4, [ten] * 4, [five] * 3 + [five ^ np.uint64(15)]], np.uint64)
    rows = [(i, row) for i, row in enumerate(simhash.coordinates(x).view(np.int64).tolist())]
    keys = [r["k"] for r in spark.createDataFrame(rows, "i long, t array<long>").select("i", simhash.near_keys(F.col("t"), 6, 40).alias("k")).orderBy("i").collect()]
    assert keys[0] == keys[1] and len(set(keys[0])) == 40
    bits, n_keys, words = simhash.plan_keys(10**5)
    assert bits % 2 == 0 and bits * n_keys <= 64 * words
    links = simhash.near_links(x, (4, 5))(0, 3, np.arange(3))
    assert not links[0, 1] and links[0, 2] and links[2, 0]


def test_common_shingles():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, n)).astype(np.uint64) for n in (5, 100, 1, 250, 40)]
    got = simhash.common_shingles(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_stage_equals_brute_force_on_planted_near_copies(docs, monkeypatch):
    rows = planted()
    expected = brute_survivors(rows)
    assert 45 < len(expected) < len(rows) - 100
    d = docs(rows)
    got = simhash.drop_near_duplicates(d)
    assert got.columns == d.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(expected)
    monkeypatch.setattr(simhash, "TILE", 7)
    cut = simhash.drop_near_duplicates(d, tile=3)  # every bucket and group is cut into blocks
    assert sorted(r["doc_id"] for r in cut.collect()) == sorted(expected)


def test_keys_grow_with_the_table():
    for n in (100, 10**5, 10**7, 10**9):
        bits, keys, words = simhash.plan_keys(n)
        assert bits * keys <= 64 * words and (1 - (1 - np.arccos(8 / 9) / np.pi) ** bits) ** keys <= 0.001
        assert n / 2**bits <= simhash.BUCKET or bits == 4


def test_repeated_rows_null_ids_long_texts_and_no_rows(docs):
    rows = [(1, "a b c d e f g", "en", "s")] * 2 + [(None, "q r s t u v", "en", "s"), (None, "other words stand here now", "en", "s"), (1, "x y z", "en", "s")]
    rows += [(7, "w " * 200_000 + "end", "en", "s"), (8, "w " * 200_000 + "end", "en", "s"), (None, None, "en", "s"), (9, "", "en", None)]
    got = simhash.drop_near_duplicates(docs(rows)).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:3]) for r in got) == [(0, "oth"), (0, "q r"), (1, "a b"), (1, "x y"), (7, "w w"), (9, "")]
    assert simhash.drop_near_duplicates(docs([])).count() == 0 and simhash.near_duplicates(docs([])).count() == 0
