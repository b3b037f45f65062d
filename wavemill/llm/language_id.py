"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* Features: n-grams of 1 to 3 characters of the lower-cased text, everything but letters
  read as one space, hashed to BUCKETS slots.  A slot's value is its share of the text's
  n-grams times its inverse document frequency, which counts *all* labelled training rows.
* Training: follow-the-regularised-leader with elastic-net penalties (per-coordinate
  rates, exact zeros) over a bounded sample, at most ``per_lang`` documents a language
  (those with the smallest hash of their id); a fifth of the sample is kept aside and sets
  one temperature by maximum likelihood, so that scores are calibrated.
* Prediction: one pass over every whole text; the weights, BUCKETS x languages, are
  broadcast, a size that doesn't depend on the corpus.

Only text and language of training rows are ever learned from; ids only choose rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavemill.llm.common import slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SCALE = 50.0
PER_LANG = 600
UNDETERMINED = "und"
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None, block: int = 1 << 18):
    """The slot of every n-gram of the text, repeats included, in arrays of bounded size;
    none if the text has no letter."""
    if not text:
        return
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stands for the run
    c = np.concatenate([[32], np.where(letter, c, 32)[keep], [32]]).astype(np.uint32)
    for at in range(0, len(c), block):
        part = c[at : at + block + ORDERS[-1] - 1].astype(np.uint64)
        out, h = [], np.zeros(len(part), np.uint64)
        for n in ORDERS:
            m = min(block, len(part) - n + 1)
            if m <= 0:
                break
            h = h[: len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1 :] + np.uint64(n)
            out.append(((h[:m] * MIX[n % 3]) >> np.uint64(48)).astype(np.int64))
        yield np.concatenate(out)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The slots that occur in a text, in order, and how often."""
    blocks = [np.unique(g, return_counts=True) for g in grams(text)]
    if len(blocks) < 2:
        return blocks[0] if blocks else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    total = np.zeros(BUCKETS, np.int64)
    for slots, counts in blocks:
        total[slots] += counts
    return (some := np.flatnonzero(total)), total[some]


def _frequencies(batches):
    """How many documents have each slot; slot -1 counts the documents."""
    df, seen, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, bool), 0
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            any_ = False
            for g in grams(text):
                seen[g] = any_ = True
            if any_:
                df += seen
                seen.fill(False)
                n += 1
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({"slot": pa.array([-1, *some.tolist()], pa.int64()), "n": pa.array([n, *df[some].tolist()], pa.int64())})


def _counts(batches):
    for batch in slices(batches):
        slots, counts = [], []
        for text in batch.column("text").to_pylist():
            g = gram_counts(text)
            slots.append(g[0].astype(np.uint16).tobytes())
            counts.append(g[1].astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("lang"), pa.array(slots, pa.binary()), pa.array(counts, pa.binary())], names=["ord", "lang", "slots", "counts"])


def ftrl(examples, n_classes: int, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001) -> np.ndarray:
    """Weights (BUCKETS + 1, classes), the last row being the bias.

    ``examples`` are (slots, values, class); the proximal update keeps z and n for each
    weight and reads it as 0 while |z| <= l1."""
    z, n = np.zeros((BUCKETS + 1, n_classes)), np.zeros((BUCKETS + 1, n_classes))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for slots, values, label in examples:
            zi, ni = z[slots], n[slots]
            w = weights(zi, ni)
            s = values @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = values[:, None] * p
            total = ni + g * g
            z[slots] = zi + g - (np.sqrt(total) - np.sqrt(ni)) / alpha * w
            n[slots] = total
    return weights(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The one that maximises the likelihood of the labels, by golden-section search."""

    def loss(t):
        s = logits / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), labels]))

    lo, hi, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Model:
    def __init__(self, langs, weights, idf, temp):
        self.langs, self.temp = langs, temp
        self.table = (weights[:-1] * idf[:, None] * SCALE).astype(np.float32)
        self.bias = weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        s, n = np.zeros(len(self.langs)), 0
        for g in grams(text):
            s += np.take(self.table, g, axis=0).sum(0, dtype=np.float64)
            n += len(g)
        if not n or not self.langs:
            return UNDETERMINED, 0.0
        s = (s / n + self.bias) / self.temp
        p = np.exp(s - s.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the rows that are not held out and have a language.  Without such rows
    it knows no language and finds every text undetermined."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = {r["slot"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator()}
    total = found.pop(-1, 0)
    df = np.zeros(BUCKETS)
    df[list(found)] = list(found.values())
    idf = np.log((1 + total) / (1 + df)) + 1
    # Of each language the rows with the smallest hashes; a first cut by the hash leaves about
    # four times as many as are kept, so that few reach the ranking, however large the corpus.
    mark = F.xxhash64(F.col("id").cast("string"))
    ids = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang")).where(~held_out(F.col("id")) & F.col("lang").isNotNull()).select("lang", mark.alias("ord"))
    cuts = {r["lang"]: min(2**63 - 1, -(2**63) + 2**64 * 4 * per_lang // r["n"]) for r in ids.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not cuts:
        return Model([], np.zeros((BUCKETS + 1, 0)), idf, 1.0)
    cut = F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv])
    least = Window.partitionBy("lang").orderBy("ord")
    limits = ids.where(F.col("ord") <= cut[F.col("lang")]).withColumn("rn", F.row_number().over(least)).where(F.col("rn") <= per_lang).groupBy("lang").agg(F.max("ord").alias("last"))
    bounds = {r["lang"]: r["last"] for r in limits.collect()}  # a row for each language
    if not bounds:
        return Model([], np.zeros((BUCKETS + 1, 0)), idf, 1.0)
    within = F.create_map(*[F.lit(x) for kv in bounds.items() for x in kv])
    sample = rows.withColumn("ord", mark).where(F.col("ord") <= within[F.col("lang")]).select("ord", "lang", "text")
    # Rows of one id, or of none, share a hash; the limit holds for these too.
    sample = sample.mapInArrow(_counts, "ord long, lang string, slots binary, counts binary").orderBy("ord", "lang", "slots", "counts").limit(per_lang * len(bounds))
    got = sorted(sample.collect(), key=lambda r: (r["ord"], r["lang"], bytes(r["slots"])))
    langs = sorted(bounds)
    examples, aside, taken = [], [], dict.fromkeys(langs, 0)
    for r in got:
        slots, counts = np.frombuffer(bytes(r["slots"]), np.uint16).astype(np.int64), np.frombuffer(bytes(r["counts"]), np.uint32)
        if not len(slots) or taken[r["lang"]] >= per_lang:
            continue
        taken[r["lang"]] += 1
        x = np.append(counts / counts.sum() * idf[slots] * SCALE, 1.0)
        (aside if taken[r["lang"]] % 5 == 0 else examples).append((np.append(slots, BUCKETS), x, langs.index(r["lang"])))
    del got
    weights = ftrl(examples, len(langs))
    logits = np.array([v @ weights[s] for s, v, _ in aside])
    temp = temperature(logits, np.array([y for _, _, y in aside])) if aside else 1.0
    return Model(langs, weights, idf, temp)


def _predict(model):
    def run(batches):
        for batch in slices(batches):
            found = [model.value.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            lang, score = pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lang, score], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Null texts and texts without letters are ``und`` with score 0; of equal scores the
    language that sorts first wins.  Null ids are not held out; repeated rows get a row
    each; other columns are not read.  An empty table gives no rows."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, per_lang, id_col, text_col, lang_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def _keep(model, at: int, min_score: float):
    def run(batches):
        for batch in slices(batches):
            found = [model.value.predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= min_score for lang, score in found], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, min_score: float = 0.5, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows and columns of ``docs`` whose language is determined with at least ``min_score``;
    null texts and texts without letters go."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, per_lang, id_col, text_col, lang_col))
    return docs.mapInArrow(_keep(model, docs.columns.index(text_col), min_score), docs.schema)
