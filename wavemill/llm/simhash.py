"""SimHash near-dedup with pivot distance tables.

Each distinct fingerprint x gets a row of its Hamming distances d(x, p) to fixed reference
fingerprints p (pivots).  By the triangle inequality |d(x, p) - d(y, p)| <= d(x, y), so a
pair whose rows differ anywhere by more than the threshold can't be a link.

* Pivots: zero, and for each pair of neighbouring bits the fingerprint with just these two
  set.  With d(x, 0) the distance to such a pivot gives the number of bits that x has there.
* Candidates: the 32 pair pivots form BANDS groups.  Two fingerprints that differ in t bits
  differ in at most t groups, so they agree in the coordinates of all the other groups: an
  equi-join on the coordinates of each choice of BANDS - t groups meets every link.
* Discard: within such a bucket, tiles of rows are compared coordinate by coordinate and
  pairs whose largest difference exceeds the threshold drop out; survivors are verified.
* A tile gives back only a spanning forest of its links, so a bucket of m fingerprints
  yields fewer than m rows a tile, never all its pairs; buckets of more than TILE
  fingerprints are cut into blocks and each pair of blocks is a tile of its own.

Copies share a fingerprint and count as one from the start.

``drop_near_duplicates`` is the same for a Jaccard similarity of word shingles.  There two
fingerprints differ in far more bits (15 % of them at 0.8), which no exact join of 64 bits
could stand, so fingerprints have several words of 64 bits:

* Pivots: the same 33 for each word; the pivot table holds the coordinates that the distances give.
* Candidates: a key is the coordinates of ``bits`` / 2 pair pivots; there are as many keys as a
  pair right at the similarity misses all of with probability MISS at most.
* Discard: within a bucket, pairs whose coordinates differ by more than the radius in sum drop out.
  By the triangle inequality two fingerprints differ within the bits of a pivot at least by the
  difference of its coordinates, and as these bits are disjoint, so do the sums.
* Survivors are verified by their own distance, then by the Jaccard similarity of the whole texts'
  shingles.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import Scratch, plain_names, row_hash, sift, slices
from wavemill.llm.components import connected_components
from wavemill.llm.tiles import deal_tiles, runs, spanning_links

SEED = 42
SHINGLE = 3
BANDS = 5
TILE = 4096
# Near copies by word shingles: the similarity as a fraction, so that comparisons are exact.
SIMILARITY = (4, 5)
WORDS = 5
MISS = 0.001
# Fingerprints to a key if all its values were as frequent.  A coordinate is 0, 1, 1 or 2 for the four values
# of its bits, so by chance 3 of 8 pairs share one: with n texts, 1024**0.71 * n**0.29 share a key.
BUCKET = 1024
NEAR = 4  # words of a fingerprint that are compared
SETS = 1 << 20  # shingles that a block of a tile holds
WEIGHTS = np.random.default_rng(SEED).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PIVOTS = tuple([0] + [3 << 2 * i for i in range(32)])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the hashes of all shingles, repeats included."""
    # Python's split() on bytes parts at exactly the six ASCII white-space characters.
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    ends = (ends[-n:] - 1).tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        block = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.flatnonzero(2 * votes > n)
    return int(sum(1 << int(i) for i in bits))


def _fingerprints(batches):
    for batch in slices(batches):
        fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "mark", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, fp): mark is a hash of the text that tells rows of one id apart."""
    text = F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return picked.mapInArrow(_fingerprints, "doc_id long, mark long, fp long")


def pivot_table(fp: Column) -> list[Column]:
    """The distances of a fingerprint to all pivots."""
    return [F.bit_count(fp.bitwiseXOR(F.lit(p - (1 << 64) if p >> 63 else p))).cast("int") for p in PIVOTS]


def candidate_keys(fp: Column, threshold: int) -> list[Column]:
    """A key for each choice of BANDS - threshold groups of pivots: its coordinates, hashed."""
    d = pivot_table(fp)
    groups = [d[1 + g :: BANDS] for g in range(BANDS)]
    keys = []
    for k, chosen in enumerate(combinations(range(BANDS), BANDS - threshold)):
        # Distances to a pair pivot count from d(x, 0): the bits in the pair are (d0 - d + 2) / 2.
        coordinates = [d[0] - x for g in chosen for x in groups[g]]
        keys.append(F.xxhash64(F.lit(k), *coordinates))
    return keys


def _distances(x: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(x ^ np.uint64(p)) for p in PIVOTS]).astype(np.int8)


def pivot_links(x: np.ndarray, threshold: int):
    """For spanning_links: the pairs that no coordinate of the pivot table tells apart and
    that differ in ``threshold`` bits at most."""
    table = _distances(x)

    def found(lo, hi, columns):
        links = np.abs(table[0, lo:hi, None] - table[0, columns]) <= threshold
        i, j = np.nonzero(links)
        a, b, left = lo + i, columns[j], np.arange(len(i))
        for c in range(1, len(PIVOTS), 8):
            left = left[np.abs(table[c : c + 8, a[left]] - table[c : c + 8, b[left]]).max(0) <= threshold] if len(left) else left
        left = left[np.bitwise_count(x[a[left]] ^ x[b[left]]) <= threshold]
        links[:] = False
        links[i[left], j[left]] = True
        return links

    return found


def _bucket_links(threshold: int):
    def run(batches):
        us, vs = [], []
        for within, (fp,), n0 in runs(batches, "key", {"fp": None}):
            for i, j in spanning_links(pivot_links(fp.view(np.uint64), threshold), n0, len(fp), within):
                us.append(int(fp[i]))
                vs.append(int(fp[j]))
        yield pa.RecordBatch.from_pydict({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def fingerprint_links(fps: DataFrame, scratch: Scratch, threshold: int = 2, tile: int = TILE) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that connect all that are within
    the threshold; of links that a bucket's other links imply some are left out."""
    keyed = fps.select("fp", F.explode(F.array(*candidate_keys(F.col("fp"), threshold))).alias("key"))
    return deal_tiles(keyed, "key", "fp", tile, scratch).mapInArrow(_bucket_links(threshold), "u long, v long")


def near_duplicates(docs: DataFrame, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest
    doc_id reachable by links of at most ``threshold`` differing bits), mark.

    Null, empty and wordless texts have fingerprint zero and link like any other.  Repeated
    rows and rows that share an id stay rows of their own; a null id is no smallest id, and
    a component of null ids only has a null component_id.  An empty table gives no rows."""
    scratch = Scratch(docs.sparkSession)
    own = scratch.save(fingerprints(docs, id_col, text_col))
    classes = scratch.save(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(fingerprint_links(classes.select("fp"), scratch, threshold), scratch)
    joined = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    # Written, so that the last join is one of two plain tables, where Spark splits a hot fingerprint.
    of_fp = scratch.save(joined.join(least, "component").select("fp", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return own.join(of_fp, "fp").select("doc_id", hexed, "component_id", "mark")


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingle_set(words: list[bytes], width: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different shingles of a text; a text of fewer words is one."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1 if width else 0
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += h[k : k + n] * WEIGHTS[k]
    return np.unique(_mix(total))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def plan_keys(n: int, similarity=SIMILARITY, bucket: int = BUCKET) -> tuple[int, int, int]:
    """(bits of a key: two for each pair pivot, keys, words of a fingerprint) for n texts.

    Sets of Jaccard similarity s have a cosine of 2 s / (1 + s) at least; their fingerprints
    agree in a bit with probability 1 - angle / pi, and in the coordinate of a pair pivot at
    least if they agree in both bits."""
    agree = 1 - _angle(similarity) / math.pi
    bits = 2 * min(16, max(2, math.ceil(math.log2(max(n, 2) / bucket) / 2)))
    keys = math.ceil(math.log(MISS) / math.log1p(-(agree**bits)))
    return bits, keys, max(NEAR, -(-keys // (64 // bits)))


def _angle(similarity) -> float:
    p, q = similarity
    return math.acos(2 * p / (p + q))


def radius(n_bits: int, similarity=SIMILARITY) -> int:
    """Bits in which fingerprints of sets right at the similarity differ, plus five deviations."""
    differ = _angle(similarity) / math.pi
    return math.ceil(n_bits * differ + 5 * math.sqrt(n_bits * differ * (1 - differ)))


def coordinates(x: np.ndarray) -> np.ndarray:
    """The pivot table of fingerprints, a word for each of theirs: of the distances to zero and
    to a pair pivot the coordinate (d(x, 0) - d(x, p)) / 2 + 1, which is 0, 1 or 2, as so many
    ones in the pivot's two bits.  The sum of differences of coordinates is a bit count then."""
    origin, out = np.bitwise_count(x).astype(np.int8), np.zeros_like(x)
    for i, p in enumerate(PIVOTS[1:]):
        at = (origin - np.bitwise_count(x ^ np.uint64(p)).astype(np.int8)) // 2 + 1
        out |= np.array([0, 1, 3], np.uint64)[at] << np.uint64(2 * i)
    return out


def near_keys(table: Column, bits: int, n_keys: int) -> Column:
    """The keys of a pivot table: each the coordinates of ``bits`` / 2 pivots, and its number."""
    per = 64 // bits
    held = lambda t: F.shiftrightunsigned(F.get(table, F.lit(t // per)), bits * (t % per)).bitwiseAND(F.lit((1 << bits) - 1))
    return F.array(*(F.lit(t << 32) + held(t) for t in range(n_keys)))


def _transposed(a: np.ndarray) -> np.ndarray:
    """Squares of 64 words (64, n), in which bits and words change places."""
    for j in (32, 16, 8, 4, 2, 1):
        pairs = a.reshape(32 // j, 2, j, -1)
        lo, hi, by = pairs[:, 0], pairs[:, 1], np.uint64(j)
        moved = (lo >> by ^ hi) & np.uint64(sum(1 << b for b in range(64) if not b & j))
        hi ^= moved
        lo ^= moved << by
    return a


def wide_fingerprints(sets: list[np.ndarray], words: int) -> np.ndarray:
    """Fingerprints of ``words`` words of 64 bits of some sets, none of them empty.

    Hashes are counted in squares of 64: with bits and words exchanged, a bit's votes are one bit count."""
    out = np.empty((len(sets), words), np.uint64)
    sizes = np.array([len(s) for s in sets])
    squares = -(-sizes // 64)  # of each set, the last filled up with zeros, which have no votes
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), squares)
    place = np.arange(len(flat)) + np.repeat(64 * (np.cumsum(squares) - squares) - (np.cumsum(sizes) - sizes), sizes)
    h = np.zeros(64 * len(owner), np.uint64)
    for w in range(words):
        for at in range(0, len(flat), 1 << 16):
            h[place[at : at + (1 << 16)]] = _mix(flat[at : at + (1 << 16)] + np.uint64((w + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        votes = np.zeros((64, len(sets)), np.int64)
        for at in range(0, len(owner), 1024):
            own = owner[at : at + 1024]
            counts = np.bitwise_count(_transposed(h[64 * at : 64 * (at + len(own))].reshape(-1, 64).T.copy()))
            votes[:, own[0] : own[-1] + 1] += np.add.reduceat(counts, np.flatnonzero(np.diff(own, prepend=-1)), axis=1, dtype=np.int64)
        out[:, w] = np.packbits(np.ascontiguousarray((2 * votes > sizes).T), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _wide(words: int):
    def run(batches):
        for batch in slices(batches, 200):
            texts = [split_words(t) for t in batch.column("text").to_pylist()]
            cls = np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED) for w in texts], np.uint64).view(np.int64)
            sets = [shingle_set(w) for w in texts]
            full = [i for i, s in enumerate(sets) if len(s)]
            fps, tables = [None] * len(sets), [None] * len(sets)
            if full:
                wide = wide_fingerprints([sets[i] for i in full], words)
                for i, row, table in zip(full, wide[:, :NEAR].view(np.int64).tolist(), coordinates(wide).view(np.int64).tolist()):
                    fps[i], tables[i] = row, table
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(cls), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.list_(pa.int64())), pa.array(tables, pa.list_(pa.int64()))],
                names=["doc_id", "mark", "cls", "size", "fp", "pivots"],
            )

    return run


def near_links(x: np.ndarray, similarity):
    """For spanning_links: the pairs of rows of x (NEAR words each) within the radius that
    their pivot tables don't tell apart, of the first three words and of all."""
    table, three, all_ = coordinates(x), radius(192, similarity), radius(64 * x.shape[1], similarity)
    firsts = [np.ascontiguousarray(table[:, w]) for w in range(3)]

    def found(lo, hi, columns):
        apart = sum(np.bitwise_count(t[lo:hi, None] ^ t[columns]) for t in firsts)  # 192 at most
        links = apart <= three
        i, j = np.nonzero(links)
        a, b = lo + i, columns[j]
        left = np.flatnonzero(np.bitwise_count(table[a] ^ table[b]).sum(1) <= all_)
        left = left[np.bitwise_count(x[a[left]] ^ x[b[left]]).sum(1) <= all_]
        links[:] = False
        links[i[left], j[left]] = True
        return links

    return found


def _candidates(similarity):
    wanted = {"cls": None} | {f"f{i}": None for i in range(NEAR)}

    def run(batches):
        for within, (cls, *fp), n0 in runs(batches, "key", wanted):
            pairs = spanning_links(near_links(np.stack(fp, 1).view(np.uint64), similarity), n0, len(cls), within)
            if pairs:
                i, j = np.array(pairs).T
                yield pa.RecordBatch.from_pydict({"u": pa.array(cls[i]), "v": pa.array(cls[j])})

    return run


def _sets(batches):
    for batch in slices(batches, 200):
        sets = [shingle_set(split_words(t)).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("component", "cls", "size")] + [pa.array(sets, pa.binary())], names=["component", "cls", "size", "shingles"])


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each pair of some sets has in common.

    Only shingles of two sets or more count; they are the columns of a 0-1 matrix, whose
    product with itself is the result."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    some = count[place] > 1
    owner, column = owner[some], column[place[some]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out, width = np.zeros((len(sets),) * 2, np.float32), 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s = slice(*np.searchsorted(column, [at, at + width]))
        block = np.zeros((len(sets), width), np.float32)
        block[owner[s], column[s] - at] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _verified(similarity):
    p, q = similarity

    def run(batches):
        blobs = {"cls": None, "shingles": lambda c: np.array(c.to_pylist(), object)}
        for within, (cls, raw), n0 in runs(batches, "component", blobs):
            sets = [np.frombuffer(s, np.uint64) for s in raw]
            size, common = np.array([len(s) for s in sets]), common_shingles(sets)
            links = q * common >= p * (size[:, None] + size - common)
            pairs = spanning_links(lambda lo, hi, columns: links[lo:hi, columns], n0, len(cls), within)
            if pairs:
                i, j = np.array(pairs).T
                yield pa.RecordBatch.from_pydict({"u": pa.array(cls[i]), "v": pa.array(cls[j])})

    return run


def drop_near_duplicates(docs: DataFrame, similarity=SIMILARITY, id_col: str = "doc_id", text_col: str = "text", tile: int = 1024) -> DataFrame:
    """The columns of ``docs``, one document of each group that links connect: the smallest
    (id, text hash), ids that are null last.  A link is a Jaccard similarity of ``similarity``
    (a fraction) or more between the sets of shingles of WORDS words.

    Null, empty and wordless texts are copies of each other; of repeated rows (one id and
    text) one stays, that with the smallest hash of all its columns.  Other columns may have any name; an empty table gives no rows."""
    scratch = Scratch(docs.sparkSession)
    bits, n_keys, words = plan_keys(docs.count(), similarity)
    text, doc, mark = F.col(text_col).cast("string"), F.col(id_col).cast("long"), _mark(F.col(text_col))
    rows = docs.select(doc.alias("doc_id"), mark.alias("mark"), text.alias("text"))
    own = scratch.save(rows.mapInArrow(_wide(words), "doc_id long, mark long, cls long, size long, fp array<long>, pivots array<long>"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    classes = scratch.save(own.groupBy("cls").agg(F.min(rank).alias("least"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("pivots").alias("pivots")))
    keyed = classes.where("fp IS NOT NULL").select("cls", *(F.get("fp", F.lit(i)).alias(f"f{i}") for i in range(NEAR)), F.explode(near_keys(F.col("pivots"), bits, n_keys)).alias("key"))
    near = deal_tiles(keyed, "key", "cls", 4 * TILE, scratch).mapInArrow(_candidates(similarity), "u long, v long")
    near = connected_components(near, scratch).withColumnRenamed("node", "cls")
    # One text of each class in a component; only texts that may be among these are shuffled.
    picked = scratch.save(near.join(classes, "cls").select("component", "cls", "size", F.col("least.doc_id").alias("__id"), F.col("least.mark").alias("__mark")))
    some = sift(rows, "mark", picked, "__mark").where("maybe")
    texts = some.join(picked.hint("merge"), (F.col("mark") == F.col("__mark")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("component", "cls", "size", "text")
    sets = scratch.save(texts.mapInArrow(_sets, "component long, cls long, size long, shingles binary").dropDuplicates(["cls"]))
    links = deal_tiles(sets, "component", "cls", tile, scratch, "size", SETS).mapInArrow(_verified(similarity), "u long, v long")
    parts = connected_components(links, scratch).withColumnRenamed("node", "cls").withColumnRenamed("component", "grp")
    grouped = classes.join(parts, "cls", "left").select("cls", F.coalesce("grp", "cls").alias("grp"), "least")
    best = grouped.groupBy("grp").agg(F.min("least").alias("best"))
    of_cls = scratch.save(grouped.join(best, "grp").select("cls", "best"))
    # What goes, and repeated rows of which one stays: few against all rows.
    known = own.join(of_cls, "cls").groupBy("doc_id", "mark").agg(F.count("*").alias("n"), F.first(F.struct(F.col("doc_id").isNull(), "doc_id", "mark") != F.col("best")).alias("gone"))
    listed = scratch.save(known.where("gone OR n > 1"))
    return _without(docs, listed, doc, mark)


def _mark(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _without(docs: DataFrame, listed: DataFrame, doc: Column, mark: Column) -> DataFrame:
    """``docs`` less the rows whose (doc_id, mark) are listed as gone, and one row of each other listed."""
    rows, names, named = plain_names(docs, doc=doc, hash=mark)
    rows = sift(rows, "hash", listed, "mark")
    asked = rows.where("maybe")
    same = lambda table: (asked["hash"] == table["mark"]) & asked["doc"].eqNullSafe(table["doc_id"])
    kept = rows.where("NOT maybe").select(*names).unionByName(asked.join(listed.hint("merge"), same(listed), "left_anti").select(*names))
    repeated = listed.where("NOT gone")
    if repeated.limit(1).count():
        one = asked.join(repeated.hint("merge"), same(repeated), "left_semi").groupBy("doc", "hash").agg(F.min_by(F.struct(*names), row_hash(names)).alias("row"))
        kept = kept.unionByName(one.select("row.*"))
    return named(kept)
