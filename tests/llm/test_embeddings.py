import numpy as np

from wavemill.llm import ann_search, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, key long"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 0) for i, v, label in rows], SCHEMA)


def corpus(n=400, dims=16):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(dims), int(i % 3)) for i in range(n)]
    for i in range(300):  # a large group of near copies, and chains of them
        rows.append((1000 + i, rows[0][1] + 0.08 * rng.standard_normal(dims), 0))
    for i in range(40):
        rows.append((2000 + i, rows[1][1] * (1 + i % 3), 1))
    nan, inf = float("nan"), float("inf")
    odd = [(3000, None, 0), (3001, np.zeros(dims), 0), (3002, [nan] + [1.0] * (dims - 1), 0), (3003, [inf] + [1.0] * (dims - 1), 0), (3004, [None] + [1.0] * (dims - 1), 0), (3005, rows[0][1], None), (3006, [1.0, 2.0], 0), (3007, [], 0), (None, rows[2][1], 2), (5, rows[5][1], 2)]
    return rows + odd


def test_near_duplicates(spark):
    rows = corpus()
    got = embedding_dedup.embedding_near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    good = [k for k, (i, v, label) in enumerate(rows) if label is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([np.float32(rows[k][1]) for k in good], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([rows[k][2] for k in good])
    link = (x @ x.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(link, False)
    true = {}
    for a, k in enumerate(good):
        true.setdefault(rows[k][0], []).append(int(link[a].sum()))
    found = {}
    for r in got:
        found.setdefault(r["vec_id"], []).append(r["n_links"])
    total = sum(map(sum, true.values()))
    mine = sum(sum(v) for k, v in found.items())
    assert 0.98 * total <= mine <= total
    assert all(max(found[k]) <= max(v) for k, v in true.items())
    by = {r["vec_id"]: r for r in got}
    assert all((by[i]["n_links"], by[i]["component_id"], by[i]["kept"]) == (0, i, True) for i in range(3000, 3008))
    assert by[1005]["component_id"] == 0 and not by[1005]["kept"] and by[2039]["component_id"] == 1 and by[2039]["n_links"] == 40
    assert found[5] == [1, 1] and by[5]["component_id"] == 5 and by[None]["n_links"] == 1 and by[None]["component_id"] == 2 and not by[None]["kept"]
    assert embedding_dedup.embedding_near_duplicates(table(spark, [])).count() == 0
    assert embedding_dedup.embedding_near_duplicates(table(spark, rows[-10:-8])).count() == 2


def test_blocks_of_a_hot_bucket_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 7)
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(16)
    rows = [(i, centre + 1e-4 * rng.standard_normal(16), 1) for i in range(60)]
    got = embedding_dedup.embedding_near_duplicates(table(spark, rows)).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(59, 0)}


def brute_search(rows, k):
    good = [(i, np.float32(v).astype(np.float64)) for i, v, _ in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in good if i != q)
            out[q] = d[:k]
    return out


def test_search(spark):
    rows = [r for r in corpus() if r[0] != 5 or r[2] is None] + [(5, corpus()[5][1], 2)]
    df = table(spark, rows)
    got = {}
    for r in ann_search.nearest_neighbours(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    true = brute_search(rows, 10)
    assert got.keys() == true.keys()
    hits = sum(len({v for *_, v in got[q]} & {v for _, v in true[q]}) for q in true)
    assert hits >= 0.9 * sum(map(len, true.values()))
    for q, found in got.items():
        assert [r for r, *_ in found] == list(range(1, 11)) and all(a[1:] <= b[1:] for a, b in zip(found, found[1:])) and q not in {v for *_, v in found}


def test_ties_and_few_candidates(spark):
    v = np.arange(1, 17)
    df = table(spark, [(i, v, 0) for i in range(300, 100, -1)])
    got = ann_search.nearest_neighbours(df, df.where("vec_id % 100 = 0"), 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(200, 101, 0), (200, 102, 0), (200, 103, 0), (300, 101, 0), (300, 102, 0), (300, 103, 0)]
    few = table(spark, [(0, v, 0), (1, v + 1, 0), (2, v + 3, 0)])
    assert [(r["rank"], r["vec_id"]) for r in ann_search.nearest_neighbours(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann_search.nearest_neighbours(few.limit(0), few.limit(0)).count() == 0


def test_vectors_of_every_length_take_part(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16), 0) for i in range(300)]
    short = [rng.standard_normal(5) for _ in range(20)]
    rows += [(1000 + i, v, 0) for i, v in enumerate(short)] + [(1100 + i, 2 * v, 0) for i, v in enumerate(short)] + [(1200, [3.0], 0), (1300, [4.0], 0)]
    by = {r["vec_id"]: r for r in embedding_dedup.embedding_near_duplicates(table(spark, rows)).collect()}
    assert all(by[1100 + i]["component_id"] == 1000 + i and by[1100 + i]["n_links"] == 1 for i in range(20))
    assert by[1300]["component_id"] == 1200 and by[0]["component_id"] == 0
    df = table(spark, rows)
    got = {}
    for r in ann_search.nearest_neighbours(df, df.where("vec_id IN (1000, 1300, 0)"), 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert len(got[0]) == 3 and got[1300] == [1200] and len(got[1000]) == 3 and all(v < 1200 for v in got[1000][:3]) and all(v >= 1000 for v in got[1000])


def test_substrings_grow_with_the_table():
    sample = np.random.default_rng(0).standard_normal((500, 24))
    for n in (100, 10**4, 10**6, 10**9):
        bits, tables, _, projection = embedding_dedup.plan(sample, n, 0.93)
        assert 2**bits >= n and projection.shape[1] >= bits * tables
        assert (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** tables <= embedding_dedup.MISS
    assert [ann_search.centroids_for(n) for n in (10, 10**5, 10**7, 10**9)] == [32, 32, 512, 1024]


def test_clustered_vectors_are_searched_in_a_small_share(spark):
    rng = np.random.default_rng(8)
    centres = 4 * rng.standard_normal((60, 16))
    x = np.float32(centres[rng.integers(0, 60, 6000)] + 0.3 * rng.standard_normal((6000, 16))).astype(np.float64)
    df = table(spark, [(i, v, 0) for i, v in enumerate(x)])
    index = ann_search.MultiIndex(x[:2000])
    cells = index.cells(x)
    index.place(np.bincount(cells, minlength=len(index.counts)))
    filled = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, cells))], "vec_id long, vec array<double>, cell int")
    assert ann_search.calibrate(index, filled, x[:128], 10, 0.97) < 0.1
    got = ann_search.nearest_neighbours(df, df.where("vec_id % 100 = 0")).collect()
    hits = 0
    for q in range(0, 6000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 600
