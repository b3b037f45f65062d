import hashlib
import math
import os

import duckdb
import numpy as np
import pytest

from wavemill.llm import queries, vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, w string, code int"
SF = "/root/testdata/sf0.001"
nan, inf = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, "x", 2) for i, v, label in rows], SCHEMA)


def corpus(n=300, dims=16, spread=1.0):
    rng = np.random.default_rng(3)
    mix = rng.standard_normal((dims, dims)) * np.geomspace(1, 0.01, dims)
    rows = [(i, spread * rng.standard_normal(dims) @ mix, None if i % 7 == 0 else i % 3) for i in range(5, n)]
    rows += [(5, rows[3][1], 1), (None, rows[4][1], 2), (900, np.zeros(dims), None)] + [(1000 + i, rows[0][1], 1) for i in range(150)]
    return rows, [(2000, None, 1), (2001, [nan] + [1.0] * (dims - 1), 1), (2002, [inf] * dims, 1), (2003, [None] + [1.0] * (dims - 1), 1), (2004, [1.0, 2.0], 1), (2005, [], 1)]


def integers(rows, scale, plus=0):
    return np.array([[math.floor(scale * float(np.float32(x))) + plus for x in v] for _, v, _ in rows], object)


@pytest.mark.parametrize("spread", [1.0, 3e7])
def test_whitening(spark, spread):
    rows, odd = corpus(spread=spread)
    got = whitening.whiten(table(spark, rows + odd)).collect()
    assert len(got) == 8 * len(rows)
    x = integers(rows, 1024, 100_000)
    n, s = len(rows), x.sum(0)
    away = n * x - s
    y = away.astype(float) / n
    e, axes = np.linalg.eigh(y.T @ y / n)
    e, axes = e[::-1], axes[:, ::-1]
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["identity_error"] < 1e-9
    deviations = {}
    for (i, *_), d in zip(rows, (away * away).sum(1)):
        deviations.setdefault(i, []).append(int(d))
    for c in range(8):
        want = {}
        for (i, *_), w in zip(rows, y @ axes[:, c] / np.sqrt(e[c])):
            want.setdefault(i, []).append(w)
        sign = np.sign(by[900][c + 1][0]["whitened"] * want[900][0])
        for i, values in want.items():
            found = by[i][c + 1]
            assert sorted(int(r["deviation"]) for r in found) == sorted(deviations[i])
            assert np.allclose(sorted(r["whitened"] for r in found), sorted(sign * w for w in values), rtol=1e-6, atol=1e-6)
            assert all(abs(r["explained"] / (e[c] / np.trace(y.T @ y / n)) - 1) < 1e-9 for r in found)


def test_whitening_edges(spark):
    rows, odd = corpus()
    assert whitening.whiten(table(spark, [])).count() == 0 and whitening.whiten(table(spark, odd[:4])).count() == 0
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0, 3.0], 0)] * 3)).collect()
    assert len(one) == 9 and all((r["whitened"], r["explained"], r["identity_error"], r["deviation"], r["n"]) == (0, 0, 0, 0, 3) for r in one)
    flat = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 0.5], 0) for i in range(10)])).collect()
    assert {r["component"]: round(r["explained"], 12) for r in flat} == {1: 1, 2: 0, 3: 0} and all(r["identity_error"] < 1e-9 for r in flat)
    assert all(r["whitened"] == 0 for r in flat if r["component"] > 1)


def test_jacobi_keeps_small_eigenvalues(spark):
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 30):
        a = rng.standard_normal((n, n))
        e, v = whitening.jacobi(a @ a.T)
        assert np.allclose(v.T @ v, np.eye(n), atol=1e-13) and np.allclose(v * e @ v.T, a @ a.T, atol=1e-12 * n * e[0]) and (np.diff(e) <= 0).all()
    d = np.array([1.0, 1e-8, 1e-16, 1e-24])
    core = np.eye(4) + 0.1 * (np.ones((4, 4)) - np.eye(4))
    e, _ = whitening.jacobi(np.sqrt(d)[:, None] * core * np.sqrt(d))
    assert abs(np.prod(e) / (np.linalg.det(core) * np.prod(d)) - 1) < 1e-12  # whose smallest value is 1e-24 of the greatest
    assert abs(e[3] / (np.linalg.det(core) / np.linalg.det(core[:3, :3]) * d[3]) - 1) < 1e-7
    pairs = [tuple(p) for a, b in whitening.rounds(7) for p in zip(a.tolist(), b.tolist())]
    assert sorted(pairs) == [(i, j) for i in range(7) for j in range(i + 1, 7)]


def lloyd(rows, parts, entries, rounds, scale=4096):
    q = integers(rows, scale)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, [float(np.float32(x)) for x in rows[k][1]]))
    step = q.shape[1] // parts
    cuts = [slice(p * step, (p + 1) * step) for p in range(parts)]
    books = [[list(q[k][c]) for k in order[:entries]] for c in cuts]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[c], e)), j) for j, e in enumerate(book)) for c, book in zip(cuts, books)] for v in q]

    for _ in range(rounds):
        at = assign()
        for p, c in enumerate(cuts):
            for j in range(len(books[p])):
                mine = [q[k][c] for k in range(len(q)) if at[k][p][1] == j]
                if mine:
                    books[p][j] = [sum(col) // len(mine) for col in zip(*mine)]
    at = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors, labels = [sum(d for d, _ in a) for a in at], {}
    for (_, _, label), e in zip(rows, errors):
        labels[label] = labels.get(label, 0) + e
    return sorted(((i, "".join(f"{j:02x}" for _, j in a), e, labels[label], digest) for (i, _, label), a, e in zip(rows, at, errors)), key=str)


@pytest.mark.parametrize("spread,parts,entries,rounds", [(1.0, 8, 16, 6), (1e6, 4, 5, 3), (1e10, 8, 16, 2), (1.0, 8, 16, 0)])
def test_codes(spark, spread, parts, entries, rounds):
    rows, odd = corpus(spread=spread)
    got = vector_codes.compress_vectors(table(spark, rows + odd).repartition(5), parts, entries, rounds).collect()
    found = sorted(((r["vec_id"], r["code"], int(r["error"]), int(r["label_error"]), r["codebooks_sha256"]) for r in got), key=str)
    assert found == lloyd(rows, parts, entries, rounds)


def test_codes_edges(spark):
    _, odd = corpus()
    assert vector_codes.compress_vectors(table(spark, [])).count() == 0 and vector_codes.compress_vectors(table(spark, odd[:4])).count() == 0
    few = vector_codes.compress_vectors(table(spark, [(i, [float(i)] * 8, None) for i in range(3)])).collect()
    assert {(r["vec_id"], r["code"], int(r["error"])) for r in few} == {(i, f"0{i}" * 8, 0) for i in range(3)}
    assert [c.stop - c.start for c in vector_codes.part_bounds(13, 8)] == [2] * 5 + [1] * 3
    odd_length = vector_codes.compress_vectors(table(spark, [(i, [float(i)] * 5, 0) for i in range(3)])).collect()
    assert all(int(r["error"]) == 0 and len(r["code"]) == 16 for r in odd_length)


def test_only_changes_are_gathered():
    books = [(slice(0, 2), np.array([[0, 0], [10, 10]])), (slice(2, 4), np.array([[0, 0], [10, 10]]))]
    changes = vector_codes.Changes(books)
    x = np.array([[1, 2, 3, 4], [9, 9, 9, 9]])
    changes.note(x, np.array([[0, 0], [1, 1]], np.uint8), np.array([[0, 1], [1, 1]], np.uint8))
    rows = changes.batch().to_pylist()
    assert [(r["part"], r["entry"], r["n"], [int(v) for v in r["sums"]]) for r in rows] == [(1, 0, -1, [-3, -4]), (1, 1, 1, [3, 4])]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["op12_delta_lloyd", "whitening_deviations"])
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    rows = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in rows.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(rows.fetchall())
