"""Exact removal of repeated byte strings by prefix-free parsing.

A byte goes if some string of WIDTH bytes that covers it also starts anywhere else in the
corpus, in the same text or another one.

* Parse: a rolling hash over BLOCK bytes triggers phrase ends at its sliding minima.  Every
  WIDTH-byte string has exactly one trigger (the leftmost minimum among its blocks), found
  from its own bytes alone, so equal strings have theirs at the same place.  The strings of
  one trigger are neighbours; the bytes they cover are its *phrase*, and consecutive phrases
  overlap by WIDTH - 1 bytes, which makes the parse free of prefixes.
* Dictionary: the distinct phrases with the number of times they occur, from a count by the
  hashes of trigger block and phrase.  Text that repeats adds nothing to it.  A phrase whose
  trigger block occurs once holds no repeated string and is dropped at once; one that
  occurs twice or more is repeated as a whole.
* Suffix array: what is left are trigger blocks with several phrases.  Their phrases are
  brought together, the suffixes of a shard of the dictionary that start a WIDTH-byte string
  are sorted, and neighbours with a common prefix of WIDTH bytes are repeats.  A trigger
  block with more than HOT phrases would not fit a task: its strings are counted by a
  128-bit hash instead, which gives the same answer.
* Parse and suffix order combine: each occurrence of a phrase takes over the repeated starts
  of its dictionary entry, and a pass over the distinct texts cuts the covered bytes out.
  The parse needs no suffix array of its own: it would order suffixes that agree beyond their
  phrase, but phrases overlap by WIDTH - 1 bytes, so the first WIDTH bytes of every suffix lie
  within one phrase, and no more is ever compared.

Copies of a text are parsed once for each part of a batch and carried as a weight.  A text is
known by 128 bits of hashes (r, q).
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import Scratch, slices

WIDTH = 200
BLOCK = 50
PIECE = 1 << 20  # starts that are parsed at a time, which bounds memory for any text
HOT = 4096
SORTED = 1 << 16  # strings that are sorted at a time
POSITION = np.uint64((1 << 24) - 1)


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, powers of an odd base modulo 2**64, and of its inverse."""
    base = 0x9E3779B97F4A7C15
    n = PIECE + WIDTH + 1
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    codes = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
    return codes, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _triggers(data: np.ndarray) -> np.ndarray:
    """For each start of a WIDTH-byte string in the data, the place of its trigger."""
    codes, up, down = _powers()
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes[data] * up[:n], dtype=np.uint64, out=sums[1:])
    h = (sums[BLOCK:] - sums[: n - BLOCK + 1]) * down[: n - BLOCK + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    # The place in the low bits breaks ties to the left.
    h = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
    span, width = WIDTH - BLOCK + 1, 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if width < span:
        h = np.minimum(h[: len(h) - (span - width)], h[span - width :])
    return (h & POSITION).astype(np.int64)


def phrases(text: bytes):
    """(trigger, first start, last start) of each phrase of a text, in order."""
    last = len(text) - WIDTH
    for at in range(0, last + 1, PIECE):
        data = np.frombuffer(text, np.uint8, min(PIECE + WIDTH - 1, len(text) - at), at)
        trigger = _triggers(data)
        begin = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
        end = np.concatenate([begin[1:], [len(trigger)]]) - 1
        yield from zip((trigger[begin] + at).tolist(), (begin + at).tolist(), (end + at).tolist())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def phrase_hashes(text: bytes, view: memoryview, trigger: int, first: int, last: int) -> tuple[int, int]:
    block = xxhash.xxh3_64_intdigest(view[trigger : trigger + BLOCK])
    phrase = xxhash.xxh3_64_intdigest(view[first : last + WIDTH], trigger - first)
    return _signed(block), _signed(phrase)


PARSED = "r long, q long, first int, last int, lead int, hb long, hx long, w long"


def _parse(batches):
    for batch in slices(batches):
        texts: dict[tuple, list] = {}
        for r, q, text in zip(*(batch.column(c).to_pylist() for c in ("r", "q", "text"))):
            texts.setdefault((r, q), [text, 0])[1] += 1
        out = [[] for _ in range(8)]
        for (r, q), (text, w) in texts.items():
            view = memoryview(text)
            for trigger, first, last in phrases(text):
                hb, hx = phrase_hashes(text, view, trigger, first, last)
                for c, v in zip(out, (r, q, first, last, trigger - first, hb, hx, w)):
                    c.append(v)
            if len(out[0]) > 50_000:
                yield _batch(out)
                out = [[] for _ in range(8)]
        yield _batch(out)


def _batch(out):
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["r", "q", "first", "last", "lead", "hb", "hx", "w"])


def _distinct(batches):
    """Rows sorted by (r, q, first) without those that repeat the one before."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in ("r", "q", "first")]
        keep = np.ones(batch.num_rows, bool)
        keep[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        keep[0] = tuple(k[0] for k in keys) != last
        last = tuple(k[-1] for k in keys)
        yield batch.filter(pa.array(keep))


def _once(batches):
    """Drops copies of a text that this task has passed on; the set is bounded."""
    seen = set()
    for batch in batches:
        if len(seen) > 1_000_000:
            seen.clear()
        keep = []
        for r in zip(batch.column("r").to_pylist(), batch.column("q").to_pylist()):
            keep.append(r not in seen)
            seen.add(r)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _by_text(batches, columns):
    """(r, q, rows, text) for each text, from rows sorted by (r, q, kind): the rows of kind 0 hold
    ``columns``, the first of kind 1 the text."""
    now, rows, done = None, [], True
    for batch in batches:
        if not batch.num_rows:
            continue
        kinds, texts = batch.column("kind").to_pylist(), batch.column("text")
        lists = [batch.column(c) for c in columns]
        for i, (*r, kind) in enumerate(zip(batch.column("r").to_pylist(), batch.column("q").to_pylist(), kinds)):
            if r != now:
                now, rows, done = r, [], False
            if kind == 0:
                rows.append(tuple(c[i].as_py() for c in lists))
            elif not done:
                done = True
                yield *r, rows, texts[i].as_py()


CONTEXTS = "hb long, hx long, w long, nd long, ctx binary"


def _bring(batches):
    out = [[] for _ in range(5)]

    def made():
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["hb", "hx", "w", "nd", "ctx"])

    for *_, rows, text in _by_text(batches, ("first", "last", "hb", "hx", "w", "nd")):
        for first, last, hb, hx, w, nd in rows:
            for c, v in zip(out, (hb, hx, w, nd, text[first : last + WIDTH])):
                c.append(v)
        if len(out[0]) > 20_000:
            yield made()
            out = [[] for _ in range(5)]
    yield made()


def repeated_starts(contexts: list[bytes]) -> list[list[int]]:
    """For each phrase the starts of WIDTH-byte strings that another start among all the
    phrases equals: a suffix array of their concatenation, cut at WIDTH bytes."""
    buffer = np.frombuffer(b"".join(contexts), np.uint8)
    lengths = np.array([len(c) for c in contexts])
    n = lengths - WIDTH + 1
    owner = np.repeat(np.arange(len(contexts)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(np.cumsum(lengths) - lengths, n) + inside
    windows = np.lib.stride_tricks.sliding_window_view(buffer, WIDTH)[starts]
    order = suffix_order(windows)
    ranked = windows[order]
    same = (ranked[1:] == ranked[:-1]).all(1)
    found = np.zeros(len(order), bool)
    found[order[1:]] |= same
    found[order[:-1]] |= same
    out = [[] for _ in contexts]
    for o, i in zip(owner[found].tolist(), inside[found].tolist()):
        out[o].append(i)
    return out


def suffix_order(windows: np.ndarray) -> np.ndarray:
    """Lexicographic order of equally long byte strings."""
    return np.argsort(np.ascontiguousarray(windows).view(np.dtype((np.void, windows.shape[1]))).reshape(-1), kind="stable")


STARTS = "hb long, hx long, starts array<int>"


def _sort_shard(batches):
    """Rows come sorted by trigger block; shards end where a block ends."""

    def solved(rows):
        found = repeated_starts([c for _, _, c in rows])
        some = [i for i, f in enumerate(found) if f]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][0] for i in some], pa.int64()), pa.array([rows[i][1] for i in some], pa.int64()), pa.array([found[i] for i in some], pa.list_(pa.int32()))],
            names=["hb", "hx", "starts"],
        )

    rows, size = [], 0
    for batch in batches:
        for hb, hx, ctx in zip(*(batch.column(c).to_pylist() for c in ("hb", "hx", "ctx"))):
            if size > SORTED and hb != rows[-1][0]:
                yield solved(rows)
                rows, size = [], 0
            rows.append((hb, hx, ctx))
            size += len(ctx) - WIDTH + 1
    if rows:
        yield solved(rows)


def _strings(batches):
    for batch in batches:
        for hb, hx, w, ctx in zip(*(batch.column(c).to_pylist() for c in ("hb", "hx", "w", "ctx"))):
            view, n = memoryview(ctx), len(ctx) - WIDTH + 1
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[a : a + WIDTH]) for a in range(n)), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array([hb] * n), pa.array([hx] * n), pa.array([w] * n), pa.array(range(n), pa.int32()), pa.array(digests[:, 0]), pa.array(digests[:, 1])], names=["hb", "hx", "w", "a", "d0", "d1"])


RESULTS = "r long, q long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(keep_text: bool):
    def run(batches):
        out = [[] for _ in range(7)]

        def made():
            kinds = (pa.int64(),) * 5 + (pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["r", "q", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

        for r, q, rows, text in _by_text(batches, ("first", "last", "starts")):
            mark = np.zeros(len(text) + 1, np.int32)
            # Copies of a text may bring a mark more than once; only covering counts.
            for first, last, starts in rows:
                if starts is None:
                    mark[first] += 1
                    mark[last + WIDTH] -= 1
                else:
                    at = np.array(starts) + first
                    mark[at] += 1
                    np.subtract.at(mark, at + WIDTH, 1)
            gone = np.cumsum(mark[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
            row = (r, q, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None)
            for c, v in zip(out, row):
                c.append(v)
            if len(out[0]) >= 2000:
                yield made()
                out = [[] for _ in range(7)]
        yield made()

    return run


def remove_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256; with ``with_text`` also kept, the remaining bytes.

    Null text is empty; texts shorter than WIDTH bytes lose nothing.  Repeated rows and null
    ids are documents each, so a repeated row's text of WIDTH bytes or more goes wholly.
    An empty table gives no rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    both = [F.xxhash64(text).alias("r"), F.xxhash64(F.lit(1), text).alias("q")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *both, text.cast("binary").alias("text"))
    parsed = scratch.save(rows.select("r", "q", "text").mapInArrow(_parse, PARSED))
    blocks = parsed.groupBy("hb").agg(F.sum("w").alias("n"), F.min("hx").alias("x0"), F.max("hx").alias("x1")).where("n > 1")
    # Written first: a join of two plain tables is one that Spark can split where a block is hot.
    blocks = scratch.save(blocks.select("hb", (F.col("x0") == F.col("x1")).alias("whole")))
    shared = scratch.save(parsed.join(blocks, "hb"))
    scratch.free(parsed)
    scratch.release()
    # The dictionary: distinct phrases of trigger blocks that have several, with one place each.
    place = F.struct("r", "q", "first", "last")
    words = scratch.save(shared.where("NOT whole").groupBy("hb", "hx").agg(F.sum("w").alias("w"), F.min(place).alias("p")))
    sizes = words.groupBy("hb").agg(F.count("*").alias("nd"))
    needed = words.join(sizes, "hb").select("p.*", "hb", "hx", "w", "nd")
    texts = rows.select("r", "q", "text").mapInArrow(_once, "r long, q long, text binary")
    none = lambda kind: F.lit(None).cast(kind)
    asked = needed.withColumn("kind", F.lit(0)).withColumn("text", none("binary"))
    given = texts.select("r", "q", none("int").alias("first"), none("int").alias("last"), none("long").alias("hb"), none("long").alias("hx"), none("long").alias("w"), none("long").alias("nd"), F.lit(1).alias("kind"), "text")
    contexts = scratch.save(asked.unionByName(given).repartition("r", "q").sortWithinPartitions("r", "q", "kind").mapInArrow(_bring, CONTEXTS))
    scratch.release()
    few = contexts.where(F.col("nd") <= HOT).select("hb", "hx", "ctx").repartition("hb").sortWithinPartitions("hb")
    strings = contexts.where(F.col("nd") > HOT).mapInArrow(_strings, "hb long, hx long, w long, a int, d0 long, d1 long")
    repeats = strings.groupBy("d0", "d1").agg(F.sum("w").alias("n")).where("n > 1").select("d0", "d1")
    many = strings.join(repeats, ["d0", "d1"]).groupBy("hb", "hx").agg(F.collect_list("a").alias("starts"))
    starts = few.mapInArrow(_sort_shard, STARTS).unionByName(many)
    # A phrase that occurs more than once is repeated whatever its neighbours are: starts null.
    entry = words.select("hb", "hx", "w").join(starts, ["hb", "hx"], "left").where("w > 1 OR starts IS NOT NULL").select("hb", "hx", F.when(F.col("w") == 1, F.col("starts")).alias("starts"))
    entry = scratch.save(entry)  # a plain table again, for a phrase that very many texts hold
    part = shared.where("NOT whole").select("r", "q", "first", "last", "hb", "hx").join(entry, ["hb", "hx"]).select("r", "q", "first", "last", "starts")
    marks = shared.where("whole").select("r", "q", "first", "last", none("array<int>").alias("starts")).unionByName(part)
    # Copies of a text have brought the same marks to the same task.
    marks = scratch.save(marks.sortWithinPartitions("r", "q", "first").mapInArrow(_distinct, "r long, q long, first int, last int, starts array<int>"))
    scratch.free(contexts, words, entry, shared, blocks)
    scratch.release()
    asked = marks.withColumn("kind", F.lit(0)).withColumn("text", none("binary"))
    given = texts.select("r", "q", none("int").alias("first"), none("int").alias("last"), none("array<int>").alias("starts"), F.lit(1).alias("kind"), "text")
    cut = scratch.save(asked.unionByName(given).repartition("r", "q").sortWithinPartitions("r", "q", "kind").mapInArrow(_cut(with_text), RESULTS))
    scratch.free(marks)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    return rows.select("doc_id", "r", "q").join(cut, ["r", "q"]).select(*columns)


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT r, k, substr(h, 500 * k + 1, 900) AS part FROM (SELECT r, h, unnest(range(0, len(h) // 500 + 1)) AS k FROM d)
), w AS (
  SELECT r, 250 * k + j AS i, md5_number(substr(part, 2 * j + 1, 400)) AS s
  FROM (SELECT r, k, part, unnest(range(0, least(250, greatest(0, len(part) // 2 - 199)))) AS j FROM p)
), c AS (
  SELECT s FROM w GROUP BY s HAVING count(*) > 1
), m AS (
  SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS step FROM w JOIN c USING (s)
), g AS (
  SELECT r, i, sum(CASE WHEN step IS NULL OR step > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM m
), runs AS (
  SELECT r, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, run
), pieces AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs
), cut AS (
  SELECT d.r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last, sum(b - a) AS gone, count(*) AS spans
  FROM pieces JOIN d USING (r) GROUP BY d.r
)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
