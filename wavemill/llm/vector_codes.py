"""Vector code compression: product codes whose codebooks are kept up to date by differences.

Vectors, as integers floor(scale * component), are cut into consecutive parts; each part has a
codebook.  Lloyd's rounds give every part the nearest entry and then move each entry to
the floor of its parts' mean.  The sums behind the means are never computed anew: vectors are
stored with the entries they had, a round gathers only what parts whose entry has changed take
away from one sum and add to another (summed up within a task first, so a task sends at
most an entry's sums for each entry), and the driver, which holds the running sums of all entries
(dims x entries integers), applies them.  Everything is counted in integers: neither the
order of rows nor a task that is run again can change a result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import Scratch
from wavemill.llm.vector_rows import FAR, blocks, decimals, magnitude, product, scaled, usable_rows

WIDTHS = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))
STATE = "vec_id long, label string, vec binary, code binary, part int, entry int, n long, sums array<decimal(38,0)>"


def part_bounds(dims: int, parts: int) -> list[slice]:
    """Consecutive parts of equal length; if dims is no multiple, the first ones are longer by one."""
    ends = np.cumsum([0] + [dims // parts + (p < dims % parts) for p in range(parts)]).tolist()
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties to the lower index) and its squared distance, exact."""
    if 4 * magnitude(x, book) ** 2 * max(x.shape[1], 1) >= 1 << 53:
        x, book = x.astype(object), book.astype(object)
    far = (x * x).sum(1)[:, None] - 2 * product(x, book.T) + (book * book).sum(1)[None, :]
    at = far.argmin(1) if far.dtype != object else np.array([min(range(len(r)), key=lambda k: (r[k], k)) for r in far.tolist()], np.int64)
    return at, far[np.arange(len(x)), at]


def encode(x: np.ndarray, books) -> tuple[np.ndarray, np.ndarray]:
    codes, errors = np.empty((len(x), len(books)), np.uint8), np.zeros(len(x), object)
    for p, (cut, book) in enumerate(books):
        codes[:, p], far = nearest(x[:, cut], book)
        errors = errors + far
    return codes, errors


def pack(x: np.ndarray) -> pa.Array:
    """Rows as bytes, in the narrowest integers that hold all of them."""
    kind = next(k for k in WIDTHS if np.iinfo(k).min <= x.min(initial=0) and x.max(initial=0) <= np.iinfo(k).max)
    raw, step = np.ascontiguousarray(x.astype(kind)).tobytes(), kind.itemsize * x.shape[1]
    return pa.array([raw[i * step : (i + 1) * step] for i in range(len(x))], pa.binary())


def unpack(column: pa.Array, dims: int) -> np.ndarray:
    rows = column.to_pylist()
    if len({len(r) for r in rows}) == 1:
        return np.frombuffer(b"".join(rows), f"<i{len(rows[0]) // dims}").reshape(-1, dims).astype(np.int64)
    return np.array([np.frombuffer(r, f"<i{len(r) // dims}") for r in rows], np.int64)


class Changes:
    """What the rows of a task take from and add to the sums of each (part, entry)."""

    def __init__(self, books):
        self.books = books
        self.n = [np.zeros(len(b), np.int64) for _, b in books]
        self.sums = [np.zeros(b.shape, object) for _, b in books]

    def note(self, x: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> None:
        for p, (cut, book) in enumerate(self.books):
            moved = np.arange(len(x)) if old is None else np.flatnonzero(old[:, p] != new[:, p])
            entries = np.arange(len(book))
            sign = (new[moved, p][:, None] == entries).astype(np.int64)
            if old is not None:
                sign -= old[moved, p][:, None] == entries
            self.n[p] += sign.sum(0)
            self.sums[p] = self.sums[p] + product(sign.T, x[moved][:, cut])

    def batch(self) -> pa.RecordBatch:
        keys = [(p, e) for p, (_, book) in enumerate(self.books) for e in range(len(book)) if self.n[p][e] or any(self.sums[p][e])]
        return _state(
            part=pa.array([p for p, _ in keys], pa.int32()), entry=pa.array([e for _, e in keys], pa.int32()), n=pa.array([int(self.n[p][e]) for p, e in keys], pa.int64()),
            sums=pa.array([[int(v) for v in self.sums[p][e]] for p, e in keys], pa.list_(pa.decimal128(38, 0))),
        )


def _state(**columns) -> pa.RecordBatch:
    kinds = {"vec_id": pa.int64(), "label": pa.string(), "vec": pa.binary(), "code": pa.binary(), "part": pa.int32(), "entry": pa.int32(), "n": pa.int64(), "sums": pa.list_(pa.decimal128(38, 0))}
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[c].cast(k) if c in columns else pa.nulls(size, k) for c, k in kinds.items()], names=list(kinds))


def _codes(codes: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in codes], pa.binary())


def _assign(scale: int, dims: int, books, first: bool):
    """Rows with their new entries, and after them the changes of the task's sums."""

    def run(batches):
        changes = Changes(books)
        for part in blocks(batches):
            x = scaled(part.column("vec"), scale) if first else unpack(part.column("vec"), dims)
            old = None if first else np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            new, _ = encode(x, books)
            changes.note(x, old, new)
            yield _state(vec_id=part.column("vec_id"), label=part.column("label"), vec=pack(x) if first else part.column("vec"), code=_codes(new))
        out = changes.batch()
        if out.num_rows:
            yield out

    return run


def _final(scale: int, dims: int, books, first: bool):
    def run(batches):
        for part in blocks(batches):
            x = scaled(part.column("vec"), scale) if first else unpack(part.column("vec"), dims)
            codes, errors = encode(x, books)
            text = pa.array([r.tobytes().hex() for r in codes])
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), text, decimals(errors)], names=["vec_id", "label", "code", "error"])

    return run


def apply_changes(books, counts, sums, rows) -> list:
    """Adds the changes to the running sums and moves the entries that have parts to the floor of their means."""
    for r in rows:
        counts[r["part"]][r["entry"]] += r["n"]
        at = sums[r["part"]][r["entry"]]
        at[r["pos"]] += int(r["total"])
    out = []
    for p, (cut, book) in enumerate(books):
        moved = [[s // counts[p][e] for s in sums[p][e]] if counts[p][e] else row for e, row in enumerate(book.tolist())]
        out.append((cut, np.array(moved, np.int64).reshape(book.shape)))
    return out


def compress_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per usable vector: vec_id, label (as text), code (two hex digits for each part), error (its
    squared distances, summed over parts), label_error (errors summed over equal labels, nulls
    together), codebooks_sha256 (of all entries' integers, by part, entry and position, joined by commas).
    Errors are decimal(38,0).

    Codebooks begin with the vectors of the ``entries`` smallest ids (null last; rows of one id by their
    components), fewer if there are fewer; entries without parts stay where they are.
    Vectors that are null, empty, hold null or non-finite components or have another length
    than most are left out.  Components beyond 2**50 / scale count as that.  Repeated rows
    count each; other columns are not read; without usable vectors there are no rows."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows, dims = usable_rows(vectors, id_col, vector_col, label=label_col)
    rows = rows.withColumn("label", F.col("label").cast("string"))
    if not dims:
        return spark.createDataFrame([], "vec_id long, label string, code string, error decimal(38,0), label_error decimal(38,0), codebooks_sha256 string")
    seeds = rows.select("vec_id", "vec").orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).collect()
    start = np.clip(np.floor(np.array([r["vec"] for r in seeds]) * scale), -FAR, FAR).astype(np.int64)
    books = [(cut, start[:, cut]) for cut in part_bounds(dims, parts)]
    counts = [[0] * len(b) for _, b in books]
    sums = [[[0] * b.shape[1] for _ in range(len(b))] for _, b in books]
    held = rows
    for r in range(rounds):
        state = scratch.save(held.mapInArrow(_assign(scale, dims, books, r == 0), STATE))
        changed = state.where("part IS NOT NULL").select("part", "entry", "n", F.posexplode("sums").alias("pos", "v"))
        changed = changed.groupBy("part", "entry", "pos").agg(F.sum(F.when(F.col("pos") == 0, F.col("n")).otherwise(0)).alias("n"), F.sum("v").alias("total"))
        books = apply_changes(books, counts, sums, changed.collect())
        if r:
            scratch.free(last)
        last, held = state, state.where("part IS NULL").select("vec_id", "label", "vec", "code")
    coded = scratch.save(held.mapInArrow(_final(scale, dims, books, rounds == 0), "vec_id long, label string, code string, error decimal(38,0)"))
    if rounds:
        scratch.free(last)
    labels = scratch.save(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    digest = hashlib.sha256(",".join(str(v) for _, b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()
    out = coded.join(labels, coded["label"].eqNullSafe(labels["of"]))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


_FLOORS = "list_transform(CAST(embedding AS DOUBLE[]), lambda c: CAST(floor(4096 * c) AS BIGINT))"
ORACLE_SQL = f"""
WITH RECURSIVE u AS (
  SELECT row_number() OVER () AS k, vec_id, label, {_FLOORS} AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), p AS MATERIALIZED (
  SELECT k, part, list_slice(q, part * (len(q) // 8) + 1, (part + 1) * (len(q) // 8)) AS v FROM (SELECT k, q, unnest(range(8)) AS part FROM u)
), seed AS (
  SELECT k, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT k, vec_id FROM u ORDER BY vec_id LIMIT 16)
), book AS (
  SELECT 0 AS round, part, CAST(entry AS BIGINT) AS entry, v FROM p JOIN seed USING (k)
  UNION ALL
  SELECT round + 1, part, entry, CASE WHEN len(mean) > 0 THEN mean ELSE v END FROM (
    SELECT b.round, b.part, b.entry, b.v,
      coalesce(list_transform(range(len(b.v)), lambda i: CAST(floor(list_sum(list_transform(m.vs, lambda x: CAST(x[i + 1] AS DOUBLE))) / len(m.vs)) AS BIGINT)), []) AS mean
    FROM book b LEFT JOIN (
      SELECT part, entry, list(v) AS vs FROM (
        SELECT p.k, p.part, any_value(p.v) AS v, arg_min(b.entry, list_sum(list_transform(range(len(p.v)), lambda i: (p.v[i + 1] - b.v[i + 1]) * (p.v[i + 1] - b.v[i + 1]))) * 16 + b.entry) AS entry
        FROM p JOIN book b ON b.part = p.part GROUP BY p.k, p.part
      ) GROUP BY part, entry
    ) m ON m.part = b.part AND m.entry = b.entry
    WHERE b.round < 6
  )
), last AS (
  SELECT * FROM book WHERE round = 6
), a AS (
  SELECT p.k, p.part, arg_min(l.entry, d * 16 + l.entry) AS entry, min(d) AS d FROM (
    SELECT p.k, p.part, l.entry, list_sum(list_transform(range(len(p.v)), lambda i: (p.v[i + 1] - l.v[i + 1]) * (p.v[i + 1] - l.v[i + 1]))) AS d FROM p JOIN last l ON l.part = p.part
  ) p JOIN last l ON l.part = p.part AND l.entry = p.entry GROUP BY p.k, p.part
), c AS (
  SELECT k, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY k
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM last) AS codebooks_sha256
FROM u JOIN c USING (k)
"""
