"""Approximate nearest neighbours by an inverted multi-index.

* Index: both halves of the vectors are quantised apart (k-means on a bounded sample of
  SAMPLE vectors); a pair of centroids is a cell, and *every* vector is put into its cell.
  The number of centroids grows with the root of the number of vectors (up to MOST).
* Traversal: for a query the sums of its squared distances to the two centroids order the
  cells; a heap pops them in that order (Babenko & Lempitsky's multi-sequence walk) until
  the cells seen hold ``share`` of all vectors.  ``share`` is calibrated: PROBES vectors of
  the sample look for their neighbours among all vectors, and the share is the least at which
  their walks would find TARGET of them.
* Rerank: candidates lie in blocks of about BLOCK vectors, near cells after each other (both
  halves' centroids along their main axis, interleaved), and a cell of more than a block is
  spread over several; each query goes to the blocks that hold a cell it visits, is compared
  there with the originals of these cells only, and leaves its best k of each block for the
  final order.

Vectors of different lengths are never neighbours; each length has an index of its own.
Of vectors that are exactly equal only the k + 1 with the smallest ids can ever be among
the k nearest (ties go to the smaller id), so the others leave before the index is filled.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavemill.llm.common import Scratch
from wavemill.llm.embedding_dedup import bounded_sample, matrix, usable

SAMPLE = 8192
CENTROIDS, MOST = 32, 1024
PROBES = 128
TARGET = 0.97
BLOCK = 4096
CHUNK = 256
FOUND = "query_id long, vec_id long, score double"


def kmeans(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    x = np.ascontiguousarray(x)
    some = np.unique(x, axis=0)
    k = min(k, len(some))
    c = some[np.random.default_rng(0).choice(len(some), k, replace=False)].copy()
    for _ in range(rounds):
        own = squared(x, c).argmin(1)
        for i in range(k):
            if (mine := own == i).any():
                c[i] = x[mine].mean(0)
    return c


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


def centroids_for(n: int) -> int:
    return min(MOST, max(CENTROIDS, 1 << max(0, round(math.log2(max(n, 1)) / 2) - 3)))


class MultiIndex:
    """Centroids of both halves, and how many vectors each cell holds."""

    def __init__(self, sample: np.ndarray, centroids: int = CENTROIDS):
        self.dims = sample.shape[1]
        self.half = max(1, self.dims // 2)
        self.left = self.along(kmeans(sample[:, : self.half], centroids))
        # One-dimensional vectors have an empty second half, which is one cell.
        self.right = self.along(kmeans(sample[:, self.half :], centroids)) if self.dims > 1 else np.zeros((1, 0))
        self.counts = np.zeros(len(self.left) * len(self.right), np.int64)

    @staticmethod
    def along(c: np.ndarray) -> np.ndarray:
        """Centroids in the order of their main axis."""
        centred = c - c.mean(0)
        return c[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]

    def place(self, counts: np.ndarray) -> None:
        """Deals the cells to blocks, in the order of both halves' interleaved numbers."""
        self.counts = counts
        a, b = np.divmod(np.arange(len(counts)), len(self.right))
        code = sum(((a >> i & 1) << 2 * i + 1) | ((b >> i & 1) << 2 * i) for i in range(MOST.bit_length()))
        order = np.argsort(code, kind="stable")
        before = np.empty(len(counts), np.int64)
        before[order] = np.cumsum(counts[order]) - counts[order]
        self.first, self.span = before // BLOCK, np.maximum(-(-counts // BLOCK), 1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return squared(x[:, : self.half], self.left).argmin(1) * len(self.right) + squared(x[:, self.half :], self.right).argmin(1)

    def blocks(self, cells: np.ndarray, ids: np.ndarray) -> np.ndarray:
        spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        return self.first[cells] + spread % self.span[cells]

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(x[:, : self.half], self.left), squared(x[:, self.half :], self.right)

    def walk(self, d_left: np.ndarray, d_right: np.ndarray, least: float):
        """Cells by summed distance until they hold ``least`` vectors."""
        a, b = np.argsort(d_left, kind="stable"), np.argsort(d_right, kind="stable")
        da, db, a, b = d_left[a].tolist(), d_right[b].tolist(), a.tolist(), b.tolist()
        heap, seen, held, width = [(da[0] + db[0], 0, 0)], {(0, 0)}, 0, len(b)
        while heap and held < least:
            _, i, j = heapq.heappop(heap)
            cell = a[i] * width + b[j]
            if self.counts[cell]:
                held += int(self.counts[cell])
                yield cell
            for n in ((i + 1, j), (i, j + 1)):
                if n[0] < len(a) and n[1] < width and n not in seen:
                    seen.add(n)
                    heapq.heappush(heap, (da[n[0]] + db[n[1]], *n))

    def needed(self, query: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The share of all vectors that the query's walk has seen once it is through each of the cells."""
        dl, dr = self.sums(query[None])
        sums = (dl[0][:, None] + dr[0]).reshape(-1)
        return np.array([self.counts[sums <= sums[c]].sum() for c in cells]) / max(1, self.counts.sum())


def _fill(index):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cells = index.value.cells(matrix(batch.column("vec")))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(cells, pa.int32())], names=["vec_id", "vec", "cell"])

    return run


def _probe(probes, k: int):
    """The k nearest of a task's vectors to each probe, with their cells."""

    def run(batches):
        near, cell = np.full((len(probes.value), k), np.inf), np.full((len(probes.value), k), -1)
        for batch in batches:
            if batch.num_rows:
                d = np.hstack([near, squared(probes.value, matrix(batch.column("vec")))])
                c = np.hstack([cell, np.broadcast_to(batch.column("cell").to_numpy(), (len(near), batch.num_rows))])
                best_k = np.argpartition(d, k - 1, 1)[:, :k]
                near, cell = np.take_along_axis(d, best_k, 1), np.take_along_axis(c, best_k, 1)
        q, i = np.nonzero(cell >= 0)
        yield pa.RecordBatch.from_pydict({"probe": pa.array(q, pa.int32()), "d": pa.array(near[q, i]), "cell": pa.array(cell[q, i], pa.int32())})

    return run


def calibrate(index: MultiIndex, filled: DataFrame, probes: np.ndarray, k: int, target: float) -> float:
    """The least share that the probes' walks must see to find ``target`` of their neighbours."""
    spark = filled.sparkSession
    order = Window.partitionBy("probe").orderBy("d", "cell")
    found = filled.mapInArrow(_probe(spark.sparkContext.broadcast(probes), k + 1), "probe int, d double, cell int")
    # The nearest is the probe itself.
    near = found.withColumn("rn", F.row_number().over(order)).where((F.col("rn") > 1) & (F.col("rn") <= k + 1)).groupBy("probe").agg(F.collect_list("cell").alias("cells"))
    shares = [index.needed(probes[r["probe"]], np.array(r["cells"])) for r in near.collect()]  # PROBES rows
    return float(min(1.0, np.quantile(np.concatenate(shares), target))) if shares else 1.0


def _place(index):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cells = batch.column("cell").to_numpy()
                block = index.value.blocks(cells, batch.column("vec_id").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns, pa.nulls(len(cells), pa.list_(pa.int32()))], names=["block", "vec_id", "vec", "cell", "seen"])

    return run


def _route(index, share):
    """A query's row for each block that holds a cell it visits, with these cells."""

    def run(batches):
        held = index.value
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                dl, dr = held.sums(matrix(part.column("vec")))
                of, block, seen = [], [], []
                for q in range(part.num_rows):
                    visits: dict[int, list] = {}
                    for c in held.walk(dl[q], dr[q], share * held.counts.sum()):
                        for b in range(held.first[c], held.first[c] + held.span[c]):
                            visits.setdefault(b, []).append(c)
                    of += [q] * len(visits)
                    block += visits
                    seen += visits.values()
                rows = pa.array(of, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block, pa.int64()), part.column("vec_id").take(rows), part.column("vec").take(rows), pa.nulls(len(of), pa.int32()), pa.array(seen, pa.list_(pa.int32()))],
                    names=["block", "vec_id", "vec", "cell", "seen"],
                )

    return run


def best(query: np.ndarray, ids: np.ndarray, x: np.ndarray, rough: np.ndarray, k: int) -> list[tuple[float, int]]:
    """The k nearest by the exact distance, ties to the smaller id; ``rough`` are squared
    distances that are right up to rounding."""
    if len(ids) > k:
        edge = np.partition(rough, k - 1)[k - 1]
        # Rounding grows with the squared lengths.
        some = np.flatnonzero(rough <= edge + 1e-6 * (1 + edge) + 1e-12 * float(query @ query))
        ids, x = ids[some], x[some]
    exact = np.sqrt(((x - query) ** 2).sum(1))
    order = np.lexsort((ids, exact))[:k]
    return [(float(exact[o]), int(ids[o])) for o in order]


def _rerank(k: int):
    """Rows come sorted by block, its vectors first, then its queries."""

    def search(held, queries):
        ids, x, cells = (np.concatenate(h) for h in held)
        out = {"query_id": [], "vec_id": [], "score": []}
        rough = squared(np.array([v for _, v, _ in queries]), x)
        for i, (qid, q, seen) in enumerate(queries):
            mine = np.flatnonzero(np.isin(cells, seen) & (ids != qid))
            for score, v in best(q, ids[mine], x[mine], rough[i, mine], k):
                out["query_id"].append(qid)
                out["vec_id"].append(v)
                out["score"].append(score)
        return pa.RecordBatch.from_arrays([pa.array(out["query_id"], pa.int64()), pa.array(out["vec_id"], pa.int64()), pa.array(out["score"], pa.float64())], names=list(out))

    def run(batches):
        now, held, queries = None, ([], [], []), []
        for batch in batches:
            if not batch.num_rows:
                continue
            block, ids, vec = batch.column("block").to_numpy(), batch.column("vec_id").to_numpy(), matrix(batch.column("vec"))
            asks = ~batch.column("seen").is_null().to_numpy(zero_copy_only=False)
            cells = batch.column("cell").fill_null(-1).to_numpy()
            cut = (np.flatnonzero((block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist()
            for a, b in zip([0, *cut], [*cut, len(block)]):
                if block[a] != now:
                    if queries and held[0]:
                        yield search(held, queries)
                    now, held, queries = block[a], ([], [], []), []
                if not asks[a]:
                    for h, v in zip(held, (ids[a:b], vec[a:b], cells[a:b])):
                        h.append(v)
                    continue
                for q in range(a, b):
                    queries.append((int(ids[q]), vec[q], batch.column("seen")[q].values.to_numpy()))
                    if len(queries) == CHUNK:
                        if held[0]:
                            yield search(held, queries)
                        queries = []
        if queries and held[0]:
            yield search(held, queries)

    return run


def _search(rows: DataFrame, asked: DataFrame, k: int, target: float, scratch: Scratch) -> DataFrame:
    """(query_id, vec_id, score) of the best candidates of each block, for vectors of one length."""
    context = rows.sparkSession.sparkContext
    # Sorting by id alone would bring all copies of a vector to one task; Spark drops all but
    # the first few of each task before that.
    same = Window.partitionBy("vec").orderBy("vec_id")
    rows = scratch.save(rows.withColumn("rn", F.row_number().over(same)).where(F.col("rn") <= k + 1).drop("rn"))
    n_centroids = centroids_for(rows.count())
    sample = bounded_sample(rows, "vec", max(SAMPLE, 16 * n_centroids))
    index = MultiIndex(sample, n_centroids)
    filled = scratch.save(rows.mapInArrow(_fill(context.broadcast(index)), "vec_id long, vec array<double>, cell int"))
    counts = np.zeros(len(index.counts), np.int64)
    for r in filled.groupBy("cell").agg(F.count("*").alias("n")).collect():  # MOST ** 2 rows at most
        counts[r["cell"]] = r["n"]
    index.place(counts)
    share = calibrate(index, filled, sample[:PROBES], k, target)
    shared = context.broadcast(index)
    schema = "block long, vec_id long, vec array<double>, cell int, seen array<int>"
    both = filled.mapInArrow(_place(shared), schema).unionByName(asked.mapInArrow(_route(shared, share), schema))
    # Null cells, the queries, come last.
    return both.repartition("block").sortWithinPartitions("block", F.col("cell").asc_nulls_last(), "vec_id").mapInArrow(_rerank(k), FOUND)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query, by Euclidean
    distance in double precision, nearest first, ties to the smaller id.

    A query never finds rows of its own id, nor vectors of another length.  Null ids, and
    vectors that are null, empty, zero or that hold null or non-finite components take no
    part.  Repeated rows are candidates each, repeated queries one; other columns are not
    read.  With fewer than k candidates all are returned; an empty table gives no rows."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)

    def clean(df):
        df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
        return df.where(F.col("vec_id").isNotNull() & usable(F.col("vec")))

    rows, asked, found = clean(vectors), clean(queries).distinct(), None
    # One index for each length that a query has; tables hold one length, or a few.
    for (length,) in sorted(asked.select(F.size("vec")).distinct().collect()):
        part = _search(rows.where(F.size("vec") == length), asked.where(F.size("vec") == length), k, target, scratch)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
