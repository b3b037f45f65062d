"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact rerank.

* Codes: vectors of unit length are centred (where that helps), taken to their principal axes and turned by a
  rotation learned so that signs lose least (ITQ; Gong & Lazebnik).  Several rotations from
  different starts give more bits than there are dimensions.  They are learned from a
  bounded sample (SAMPLE vectors with the smallest hash); every vector is then coded.
* Tables: the codes are cut into substrings of log2(n) bits, so that a bucket holds about one
  vector by chance however many there are.  Two vectors at angle a agree in a bit with
  probability 1 - a/pi, so the number of substrings follows from the threshold and the bits
  such that a pair right at it shares one with probability 1 - MISS.
* Rerank: vectors of one label and substring are compared by the cosine of the originals in
  bounded tiles (see tiles.py); a pair counts in the first substring it shares only.  A
  tile gives back a count for each row and a spanning forest of its links, never all pairs.

Exact copies under a label count as one vector with a multiplicity.  Vectors of another length
than most of the sample meet their like only; their codes come from random rotations, which
keep the same promise without having been learned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from wavemill.llm.common import Scratch
from wavemill.llm.components import connected_components
from wavemill.llm.tiles import Forest, deal_tiles, runs

SAMPLE = 4096
MISS = 0.01
TILE = 1024
ROUNDS = 30


def usable(vector) -> F.Column:
    """Not null or empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def bounded_sample(vectors: DataFrame, col: str, n: int) -> np.ndarray:
    """The n vectors with the smallest hash, of the length most of these have."""
    rows = vectors.select(col).orderBy(F.xxhash64(col), col).limit(n).collect()
    sizes = [len(r[0]) for r in rows]
    dims = max(set(sizes), key=lambda d: (sizes.count(d), -d)) if sizes else 0
    got = [r[0] for r in rows if len(r[0]) == dims]
    return np.array(got, np.float64).reshape(len(got), dims)


def unit(x: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that squares neither over- nor underflow.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def learn_rotations(sample: np.ndarray, mean: np.ndarray, seeds, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Projections (dims x bits), one for each seed: principal axes times a learned rotation."""
    x = unit(sample) - mean
    _, axes = np.linalg.eigh(x.T @ x)
    v = x @ axes
    out = []
    for seed in seeds:
        r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((v.shape[1],) * 2))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return out


def shared_substrings(sample: np.ndarray, mean: np.ndarray, projection: np.ndarray, bits: int, threshold: float) -> float:
    """How often the sample's vectors share a substring with a vector right at the threshold."""
    x = unit(sample)
    noise = np.random.default_rng(99).standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    y = threshold * x + math.sqrt(1 - threshold**2) * noise / np.maximum(np.sqrt((noise * noise).sum(1, keepdims=True)), 1e-300)
    same = ((x - mean) @ projection >= 0) == ((y - mean) @ projection >= 0)
    n = same.shape[1] // bits
    return float(same[:, : n * bits].reshape(len(x), n, bits).all(2).mean())


def plan(sample: np.ndarray, n: int, threshold: float) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Substring bits, number of substrings, mean and projection (dims x all bits) for n vectors.

    Centring balances the codes, but where most vectors lie about the mean it turns small
    angles into large ones: then the codes stay uncentred, for which the share of equal bits
    is known.  The number of substrings follows the smaller of the known and measured share."""
    dims = sample.shape[1]
    bits = min(62, max(4, math.ceil(math.log2(max(n, 2)))))
    known = (1 - math.acos(threshold) / math.pi) ** bits
    for mean in (unit(sample).mean(0), np.zeros(dims)):
        first = learn_rotations(sample, mean, range(-(-bits // dims)))
        share = shared_substrings(sample, mean, np.hstack(first), bits, threshold)
        if share >= 0.75 * known:
            break
    share = min(max(share, 0.5 * known), known, 0.999)
    tables = math.ceil(math.log(MISS) / math.log(1 - share))
    return bits, tables, mean, np.hstack(first + learn_rotations(sample, mean, range(len(first), -(-tables * bits // dims))))


def random_projection(dims: int, bits: int) -> np.ndarray:
    return np.random.default_rng(dims).standard_normal((dims, bits))


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _code(mean, projection, bits, n_tables, kind):
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)

    def code(x):
        x = unit(x)
        on = (x - mean) @ projection >= 0 if x.shape[1] == len(mean) else x @ random_projection(x.shape[1], n_tables * bits) >= 0
        return on[:, : n_tables * bits].reshape(len(x), n_tables, bits).astype(np.int64) @ weights

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size = pa.compute.list_value_length(batch.column("embedding")).to_numpy()
            subs, raw = np.empty((len(size), n_tables), np.int64), np.empty(len(size), object)
            for d in np.unique(size):
                some = np.flatnonzero(size == d)
                x = matrix(batch.column("embedding").take(pa.array(some)))
                subs[some] = code(x.astype(np.float64))
                raw[some] = [r.tobytes() for r in x.astype(kind)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, subs.size + 1, n_tables), pa.int32()), pa.array(subs.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("label"), batch.column("copies"), pa.array(raw, pa.binary()), lists], names=["cls", "label", "copies", "vec", "subs"])

    return run


def _compare(threshold: float, kind):
    blobs = lambda c: np.array(c.to_pylist(), object)
    lists = lambda c: matrix(c)

    def run(batches):
        for within, (tables, ids, copies, raw, subs), n0 in runs(batches, "key", {"t": None, "cls": None, "copies": None, "vec": blobs, "subs": lists}):
            x = unit(np.frombuffer(b"".join(raw), kind).reshape(len(ids), -1).astype(np.float64))
            a, b = np.arange(n0), np.arange(n0) if within else np.arange(n0, len(ids))
            linked = x[a] @ x[b].T >= threshold
            if within:
                linked = np.triu(linked, 1)
            i, j = np.nonzero(linked)
            if not len(i):
                continue
            i, j = a[i], b[j]
            new = np.ones(len(i), bool)  # not met before: no earlier substring is shared
            for at in range(0, len(i), 1 << 16):
                s = slice(at, at + (1 << 16))
                new[s] = ~(subs[i[s], : tables[0]] == subs[j[s], : tables[0]]).any(1)
            i, j = i[new], j[new]
            if not len(i):
                continue
            links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
            forest = Forest()
            tree = [(u, v) for u, v in zip(i.tolist(), j.tolist()) if forest.join(u, v)]
            some = np.flatnonzero(links)
            u, v = (ids[[p[k] for p in tree]] for k in (0, 1))
            yield pa.RecordBatch.from_pydict({
                "u": pa.array(np.concatenate([u, ids[some]]), pa.int64()),
                "v": pa.concat_arrays([pa.array(v, pa.int64()), pa.nulls(len(some), pa.int64())]),
                "links": pa.array(np.concatenate([np.zeros(len(tree), np.int64), links[some].astype(np.int64)]), pa.int64()),
            })

    return run


def embedding_near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id
    (smallest vec_id reachable), kept (vec_id = component_id).

    Only vectors of one non-null label and one length link.  Vectors that are null, empty, zero
    or hold null or non-finite components, and rows without a label have no links and are
    components of their own.  Repeated rows are linked copies.  A null id is no smallest id
    and is not kept.  Other columns are not read.  An empty table gives no rows."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    narrow = isinstance(vectors.schema[vector_col].dataType, ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    kind = np.dtype("<f4" if narrow else "<f8")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if narrow else "array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label"))
    in_play = F.col("label").isNotNull() & usable(F.col("embedding"))
    sample = bounded_sample(rows.where(in_play), "embedding", SAMPLE)
    # A vector is known by 128 bits of hashes; its class gets a number of its own.
    hashes = [F.when(in_play, F.xxhash64(F.lit(i), "label", "embedding")).alias(f"h{i}") for i in range(2)]
    hashed = rows.select("vec_id", "label", "embedding", *hashes)
    grouped = hashed.where("h0 IS NOT NULL").groupBy("h0", "h1", "label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = scratch.save(grouped.withColumn("cls", F.monotonically_increasing_id()))
    n = classes.count()
    if n:
        bits, n_tables, mean, projection = plan(sample, n, threshold)
        coded = scratch.save(classes.select("cls", "label", "copies", "embedding").mapInArrow(_code(mean, projection, bits, n_tables, kind), "cls long, label string, copies long, vec binary, subs array<long>"))
        slim = coded.select("cls", "label", F.length("vec").alias("size"), F.posexplode("subs").alias("t", "sub"))
        keyed = slim.select("cls", F.xxhash64("label", "size", "t", "sub").alias("key"), F.col("t").cast("int").alias("t"))
        # Most substrings are met once; vectors travel only for the others.
        shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        met = scratch.save(keyed.join(shared.select("key"), "key"))
        met = met.join(coded.drop("label"), "cls").select("key", "t", "cls", "copies", "vec", "subs")
        found = scratch.save(deal_tiles(met, "key", "cls", TILE, scratch).mapInArrow(_compare(threshold, kind), "u long, v long, links long"))
        counts = found.where("v IS NULL").groupBy(F.col("u").alias("cls")).agg(F.sum("links").alias("links"))
        parts = connected_components(found.where("v IS NOT NULL").select("u", "v"), scratch).withColumnRenamed("node", "cls")
        joined = classes.select("cls", "h0", "h1", "copies", "least").join(counts, "cls", "left").join(parts, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
        of_cls = scratch.save(joined.join(least, "component").select("h0", "h1", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
        rows = hashed.select("vec_id", "h0", "h1").join(of_cls, ["h0", "h1"], "left")
        own = F.col("h0").isNull()
        rows = rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(own, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    else:
        rows = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


# Exact, by all pairs; the query finds the links that its tables retrieve.
ORACLE_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), u AS (
  SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), c AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
), n AS (
  SELECT x, count(*) AS n_links FROM links GROUP BY x
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
