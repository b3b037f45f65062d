"""Embedding whitening: a distributed centred scatter, and cyclic Jacobi rotations on the driver.

* A component c becomes the integer x = floor(scale * c) + shift, so that every sum is exact and no
  result depends on how rows are dealt to tasks.
* The first pass sums each dimension; the second one the products of what is left of x when the
  integer nearest to its mean is taken away.  A task gives back one number for each pair
  of dimensions.  From these the covariance (divisor n) follows as a ratio of integers,
  rounded once.
* The driver turns the covariance (dims x dims, whatever the number of rows) with symmetric Jacobi rotations,
  in sweeps over all pairs, until each off-diagonal entry is negligible against its own
  two diagonal entries, which keeps small eigenvalues accurate.
* Rows are projected on the first components, and the covariance of what was written is held against the
  identity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import Scratch
from wavemill.llm.vector_rows import blocks, decimals, magnitude, product, scaled, usable_rows

EPS = 2.0**-53
SWEEPS = 60


def rounds(n: int):
    """Each pair of 0..n-1 once, in rounds of disjoint pairs (p < q), as two arrays a round."""
    seats = list(range(n + n % 2))
    for _ in range(len(seats) - 1):
        pairs = [sorted((seats[k], seats[-1 - k])) for k in range(len(seats) // 2)]
        pairs = np.array([p for p in pairs if p[1] < n], np.int64).reshape(-1, 2)
        yield pairs[:, 0], pairs[:, 1]
        seats = [seats[0], seats[-1], *seats[1:-1]]


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric matrix; the
    largest component of each is positive.  Pairs of a round are disjoint, so their rotations are
    made at once."""
    a, n = np.array(matrix, np.float64), len(matrix)
    v, least = np.eye(n), 1e-32 * np.abs(np.diag(a)).sum()
    schedule = list(rounds(n))
    for _ in range(SWEEPS):
        turned = False
        for p, q in schedule:
            off, at_p, at_q = a[p, q], a[p, p], a[q, q]
            some = np.abs(off) > EPS * np.sqrt(np.abs(at_p * at_q)) + least
            if not some.any():
                continue
            turned = True
            p, q, off, at_p, at_q = p[some], q[some], off[some], at_p[some], at_q[some]
            theta = (at_q - at_p) / (2 * off)
            t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.sqrt(t * t + 1)
            s = t * c
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[:, p], a[:, q] = c * a[:, p] - s * a[:, q], s * a[:, p] + c * a[:, q]
            v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = at_p - t * off, at_q + t * off
        if not turned:
            break
    else:
        raise RuntimeError("the Jacobi rotations did not settle")
    order = np.argsort(-np.diag(a), kind="stable")
    e, v = np.diag(a)[order], v[:, order]
    v = v / np.sqrt((v * v).sum(0))
    return e, v * np.where(v[np.abs(v).argmax(0), np.arange(n)] < 0, -1.0, 1.0)


def _sums(scale, shift):
    def run(batches):
        n, total = 0, 0
        for part in blocks(batches):
            x = scaled(part.column("vec"), scale, shift)
            n, total = n + len(x), total + x.sum(0).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "n": pa.array([n] * len(total), pa.int64()), "total": decimals(total)})

    return run


def _scatter(scale, shift, centre):
    def run(batches):
        first, second = 0, 0
        for part in blocks(batches):
            y = scaled(part.column("vec"), scale, shift) - centre
            first, second = first + y.sum(0).astype(object), second + product(y.T, y).astype(object)
        if np.ndim(first):
            i, j = np.triu_indices(len(centre))
            rows = np.arange(len(centre))
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(np.concatenate([rows, i]), pa.int32()),
                "j": pa.array(np.concatenate([np.full(len(rows), -1), j]), pa.int32()),
                "total": decimals([*first, *second[i, j]]),
            })

    return run


def _project(scale, shift, centre, n, rest, axes):
    """Rows on their axes, and the exact square sum of n*x - S = n*y - rest, with y = x - centre."""
    own, offset = sum(r * r for r in rest), np.array([r / n for r in rest])
    rest = np.array(rest, np.int64)

    def run(batches):
        for part in blocks(batches):
            y = scaled(part.column("vec"), scale, shift) - centre
            wide = magnitude(y) * max(magnitude(y), magnitude(rest)) * y.shape[1] >= 1 << 62
            z, r = (y.astype(object), rest.astype(object)) if wide else (y, rest)
            squares, mixed = (z * z).sum(1), z @ r
            away = [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(squares, mixed)]
            w = (y - offset) @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), decimals(away), lists], names=["vec_id", "deviation", "w"])

    return run


def covariance(rows: DataFrame, dims: int, scale: int, shift: int) -> tuple[np.ndarray, int, list, np.ndarray]:
    """Covariance (correctly rounded), n, sums of each dimension, and the integers nearest to their means."""
    sums = rows.select("vec").mapInArrow(_sums(scale, shift), "i int, n long, total decimal(38,0)")
    sums = {r["i"]: r for r in sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    n, totals = sums[0]["n"], [int(sums[i]["total"]) for i in range(dims)]
    centre = np.array([(2 * s + n) // (2 * n) for s in totals], np.int64)
    parts = rows.select("vec").mapInArrow(_scatter(scale, shift, centre), "i int, j int, total decimal(38,0)")
    found = {(r["i"], r["j"]): int(r["total"]) for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    out = np.empty((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            out[i, j] = out[j, i] = (n * found[i, j] - found[i, -1] * found[j, -1]) / (n * n)
    return out, n, totals, centre


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: vec_id, component (from 1, by falling eigenvalue), n,
    deviation (sum over dimensions of (n*x - S)^2, exact; decimal(38,0), null beyond), whitened,
    explained (the component's share of the variance), identity_error (one value: the largest
    entry of the covariance of ``whitened`` minus the identity).

    Vectors that are null, empty, hold null or non-finite components or have another length than
    most are left out; a zero vector is like any other.  Components beyond 2**50 / scale count as
    that.  Where a component has no variance (equal rows, a single row) ``whitened`` is 0 and the
    identity is not asked of it.  Repeated rows count each, a null id stays null, other columns are
    not read.  Without usable vectors there are no rows.  The driver holds dims * dims numbers."""
    scratch = Scratch(vectors.sparkSession)
    rows, dims = usable_rows(vectors, id_col, vector_col)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    v, n, totals, centre = covariance(rows, dims, scale, shift)
    e, axes = jacobi(v)
    trace, k = float(np.trace(v)), min(components, dims)
    live = e[:k] > dims * 2 * EPS * max(e[0], 0.0)
    turn = np.where(live, axes[:, :k] / np.sqrt(np.where(live, e[:k], 1.0)), 0.0)
    rest = [s - n * int(c) for s, c in zip(totals, centre)]
    wide = scratch.save(rows.select("vec_id", "vec").mapInArrow(_project(scale, shift, centre, n, rest, turn), "vec_id long, deviation decimal(38,0), w array<double>"))
    error = _identity_error(wide, live)
    share = F.array(*(F.lit(float(x) / trace if trace > 0 else 0.0) for x in e[:k]))
    out = wide.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def _identity_error(wide: DataFrame, live: np.ndarray) -> float:
    pairs = [(i, j) for i in np.flatnonzero(live).tolist() for j in np.flatnonzero(live).tolist() if i <= j]
    if not pairs:
        return 0.0
    got = wide.agg(*(F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs)).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(got, pairs))


# What SQL can say of it: the counts and the exact deviations.
DEVIATIONS_SQL = """
WITH u AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda c: CAST(floor(1024 * c) AS HUGEINT) + 100000) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), d AS (
  SELECT row_number() OVER () AS k, vec_id, x FROM u
), l AS (
  SELECT k, vec_id, unnest(x) AS x, unnest(range(len(x))) AS i FROM d
), s AS (
  SELECT i, CAST(sum(x) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM l GROUP BY i
)
SELECT vec_id, CAST(max(n) AS BIGINT) AS n, CAST(sum((n * x - s) * (n * x - s)) AS BIGINT) AS deviation FROM l JOIN s USING (i) GROUP BY k, vec_id
"""
