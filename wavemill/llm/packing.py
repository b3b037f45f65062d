"""Packing documents into sequences along a space-filling curve.

Each document's token ids become a hashed vector, a fixed projection takes it to a few
dimensions, and its Hilbert key orders the corpus so that similar documents are neighbours.
Documents are laid end to end along the curve and cut every ``length`` ids; what is left
at the end is cut into powers of two, so no sequence needs padding.

The order is never sorted in one task.  A histogram of the leading key bits (at most
2**HEAD buckets, whatever the corpus) gives each bucket its place on the curve.  A bucket with
more than CELL ids is cut at key boundaries: histograms of HEAD further bits at a time, down
to the whole key, give the places where about CELL ids are full, so its cells are ranges of
keys that follow each other on the curve.  Only a single key with more than CELL ids (copies
share a key) is dealt by a hash of the document.  Within a cell documents are sorted and summed.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavemill.llm.common import Scratch, slices

SLOTS = 256
DIMS, BITS = 4, 12
HEAD = 14
CELL = 1 << 21
TOKENS = "doc_id long, mark long, ids binary, n long, key long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, hilbert_key long"


class TextTokenizer:
    """Ids of whole texts by the byte-level BPE in a tokenizers file.

    Texts of Latin letters (all characters below U+0250, the bulk of such corpora) go through
    tiktoken with the very same vocabulary, which gives the same ids in a quarter of the time;
    in that range the splitting rule leaves no room for other Unicode tables.  All others,
    and texts with a special token's string or a very long run of blanks, go to tokenizers."""

    SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    OTHER = re.compile("[^\x00-\u024f]|[ \t\n\r\x0b\f]{500}")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        if self.inner.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        # Byte-level vocabularies write each byte as a printable character: printable Latin-1
        # as itself, the others from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        bytes_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.special = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        ranks = {bytes(map(bytes_of.__getitem__, w)): i for w, i in self.inner.get_vocab().items() if w not in self.special}
        self.fast = tiktoken.Encoding("same", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.OTHER.search(text) or any(x in text for x in self.special):
            return np.array(self.inner.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u2").tobytes()


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (n, dims), by Skilling's transform:
    undo the excess rotations from the top bit down, Gray-decode, interleave."""
    x = points.astype(np.int64).T.copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def document_point(ids: np.ndarray) -> np.ndarray:
    """A unit vector of signed hashed counts, projected to DIMS numbers between 0 and 2**BITS - 1."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    sign = np.where((h >> np.uint64(20)) & np.uint64(1), 1.0, -1.0)
    v = np.bincount((h >> np.uint64(56)).astype(np.int64), sign, SLOTS)
    z = _projection() @ v / max(np.sqrt(v @ v), 1e-12)
    return np.minimum((1 << BITS) / (1 + np.exp(-1.7 * z)), (1 << BITS) - 1).astype(np.int64)


def _projection() -> np.ndarray:
    i = np.arange(DIMS * SLOTS, dtype=np.uint64) + np.uint64(7)
    h = i * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.where(h >> np.uint64(63), 1.0, -1.0).reshape(DIMS, SLOTS)


def _tokenize(path: str):
    def run(batches):
        tokenizer = TextTokenizer(path)
        for batch in slices(batches):
            ids, n, points = [], [], []
            for text in batch.column("text").to_pylist():
                raw = (tokenizer.encode(text) if text else b"") + b"\0\0"
                ids.append(raw)
                n.append(len(raw) // 2)
                points.append(document_point(np.frombuffer(raw, "<u2")))
            if not ids:
                continue
            keys = hilbert_keys(np.stack(points))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(keys)], names=["doc_id", "mark", "ids", "n", "key"])

    return run


def tail_lengths(rest: int) -> list[int]:
    """The powers of two that add up to what is left, the largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cut(total: int, length: int):
    full = total // length
    starts = [full * length]
    for n in tail_lengths(total - full * length):
        starts.append(starts[-1] + n)

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "hilbert_key")}
            for doc, raw, n, at, key in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "n", "at", "key"))):
                ids, begin = np.frombuffer(raw, "<u2").astype("<u4").tobytes(), 0
                while begin < n:
                    g = at + begin
                    if g < full * length:
                        seq, seq_start, seq_end = g // length, g // length * length, (g // length + 1) * length
                    else:
                        i = int(np.searchsorted(starts, g, "right")) - 1
                        seq, seq_start, seq_end = full + i, starts[i], starts[i + 1]
                    take = min(n - begin, seq_end - g)
                    row = (doc, begin, take, zlib.crc32(ids[4 * begin : 4 * (begin + take)]), n, seq, g - seq_start, key)
                    for c, v in zip(out.values(), row):
                        c.append(v)
                    begin += take
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out.values()], names=list(out))

    return run


def _boundaries(tokens: DataFrame, heads: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, start, deals) for the crowded buckets: the first key of each of their ranges,
    and over how many cells a range is dealt by hash: 1, unless it is one key with more than
    CELL ids.  Ranges hold at most 2 * CELL ids, so there is about one for every CELL ids."""
    whole = DIMS * BITS
    found, open_, depth = None, heads.where(F.col("held") > CELL).select(F.col("bucket").alias("prefix")), HEAD
    while depth < whole:
        deeper = min(depth + HEAD, whole)
        parent = F.shiftright("key", whole - depth).alias("prefix")
        counts = tokens.select(parent, F.shiftright("key", whole - deeper).alias("child"), "n").join(open_, "prefix", "left_semi").groupBy("prefix", "child").agg(F.sum("n").alias("held"))
        # At most 2**HEAD children of a parent, so one task orders them.
        order = Window.partitionBy("prefix").orderBy("child")
        run = F.floor(F.coalesce(F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / CELL)
        marked = counts.withColumn("run", run).withColumn("crowded", F.col("held") > CELL)
        last = F.lag(F.struct("run", "crowded")).over(order)
        marked = scratch.save(marked.withColumn("first", last.isNull() | F.col("crowded") | last["crowded"] | (last["run"] != F.col("run"))))
        crowded = F.col("crowded") if deeper < whole else F.lit(False)  # a whole key is not cut further
        start = F.shiftleft("child", whole - deeper)
        deals = F.when(F.col("crowded"), F.ceil(F.col("held") / CELL)).otherwise(1).cast("int")
        cuts = marked.where(F.col("first") & ~crowded).select(F.shiftright(start, whole - HEAD).cast("int").alias("bucket"), start.alias("start"), deals.alias("deals"))
        found = cuts if found is None else found.unionByName(cuts)
        open_, depth = marked.where(crowded).select(F.col("child").alias("prefix")), deeper
    return found


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    hilbert_key.

    A document is its ids and a final 0; null and empty texts are the 0 alone.  Documents lie
    in the order of their keys; those of one key in the order of their id, or of a hash where
    the key alone holds more than CELL ids.  Repeated rows are documents each; an empty table
    gives no rows."""
    scratch = Scratch(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text, F.col(id_col).cast("long")).alias("mark"), text.alias("text"))
    tokens = scratch.save(rows.mapInArrow(_tokenize(tokenizer_path), TOKENS))
    bucket = F.shiftright("key", DIMS * BITS - HEAD).cast("int")
    heads = tokens.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("held"))
    # At most 2**HEAD rows, so one task orders them and every task can hold them.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = scratch.save(heads.withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0))))
    total = heads.agg(F.sum("held")).first()[0] or 0
    ranges = _boundaries(tokens, heads, scratch).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("start", "deals"))).alias("ranges"))
    lone = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(1).alias("deals")))
    heads = scratch.save(heads.drop("held").join(ranges, "bucket", "left").withColumn("ranges", F.coalesce("ranges", lone)))
    # The last range that starts at or before the key.
    own = F.element_at(F.filter("ranges", lambda r: r["start"] <= F.col("key")), -1)
    placed = tokens.withColumn("bucket", bucket).join(F.broadcast(heads), "bucket").withColumn("own", own)
    placed = placed.select("doc_id", "mark", "ids", "n", "key", "bucket", "base", F.col("own.start").alias("start"), F.pmod("mark", F.col("own.deals")).alias("cell"))
    cells = placed.groupBy("bucket", "start", "cell", "base").agg(F.sum("n").alias("m"))
    inner = Window.partitionBy("bucket").orderBy("start", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("bucket", "start", "cell", (F.col("base") + F.coalesce(F.sum("m").over(inner), F.lit(0))).alias("cell_base"))
    order = Window.partitionBy("bucket", "start", "cell").orderBy("key", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("inside", F.coalesce(F.sum("n").over(order), F.lit(0))).join(cells, ["bucket", "start", "cell"])
    return laid.select("doc_id", "ids", "n", (F.col("cell_base") + F.col("inside")).alias("at"), "key").mapInArrow(_cut(total, length), PIECES)
