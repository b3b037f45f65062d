"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Every document d of source s gets a rate w in (0, cap).  Among all rates whose tokens
add up to the source's target the one nearest to w = 1 in relative entropy (of the rate
and of what is left of the cap) is an exponential tilt of the odds:

    w = cap * p,  p / (1 - p) = exp(lambda_s * x) / (cap - 1),  x = size / mean size of s.

The dual is convex, with one multiplier lambda_s for each token constraint; Newton
iterations solve it for all sources at once, each a grouped sum over the table of
(source, size, documents).  Sums are decimals, so reruns agree to the last digit.  Rates
then become whole copies: from the longest documents to the shortest each size class
takes the number of copies that brings the source's running total nearest to its rates',
so only about half the shortest document is left over; in a class the copies are dealt
out as evenly as they go, in the order of a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavemill.llm.common import Scratch, plain_names, row_hash, word_count

# Parts of a class of equal documents of a source, so that no class lies in one task.
PARTS = 256
FOLD = 256  # classes that are folded at a time
KEY = ["s_null", "s"]
EXACT = "decimal(38,12)"


def target_table(sources: DataFrame, weights=(5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Adds ``target`` to (s_null, s, source_size): sources by code point, null last, weigh
    ``weights`` in turn and share the sum of all sizes; what a target has over
    ``cap * source_size`` goes to the others by weight until none is above.

    Whatever the order of resharing, the fixed point is target = min(cap * size, level * weight)
    with one level for all; sources meet their cap in the order of size / weight, so the
    level comes from two running sums.  Source names are few against documents: one row each."""
    order = Window.orderBy("s_null", "s")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double")
    t = sources.withColumn("weight", w).withColumn("full", F.lit(cap) * F.col("source_size"))
    t = t.withColumn("ratio", F.col("full") / F.col("weight"))
    up = Window.orderBy("ratio", "s_null", "s")
    t = (
        t.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("capped", F.sum("full").over(up.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("lvl", (F.col("total") - F.coalesce("capped", F.lit(0.0))) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("lvl") <= F.col("ratio"), F.col("lvl"))).over(Window.partitionBy()))
    )
    target = F.least("full", F.coalesce(F.col("level") * F.col("weight"), F.col("full")))
    return t.select(*KEY, "source_size", target.alias("target"))


def _rate(lam: Column, x: Column, cap: float) -> Column:
    return F.lit(cap) / (1 + F.lit(cap - 1.0) * F.exp(F.greatest(F.least(-lam * x, F.lit(700.0)), F.lit(-700.0))))


def _solve(classes: DataFrame, targets: DataFrame, scratch: Scratch, cap: float, rounds: int = 100) -> DataFrame:
    """(s_null, s, lam): safeguarded Newton steps on every source's dual until all have settled;
    an error if one doesn't (the bracket alone, halved each time, settles far earlier)."""
    goal = targets.withColumn("goal", F.col("target"))
    # A target at the cap (or 0) has its multiplier at infinity; 1e6 stands for that.
    full = F.col("target") >= F.lit(cap * (1 - 1e-12)) * F.col("source_size")
    now = scratch.save(
        goal.select(*KEY, "target", "source_size", "mean", F.when(full, F.lit(1e6)).otherwise(F.lit(0.0)).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), full.alias("done"))
    )
    for _ in range(rounds):
        if now.where("not done").limit(1).count() == 0:
            break
        x = F.col("size") / F.col("mean")
        w = _rate(F.col("lam"), x, cap)
        open_ = now.where("not done")
        sums = (
            classes.join(open_, KEY)
            .groupBy(*KEY)
            .agg(
                F.sum((F.col("n") * F.col("size") * w).cast(EXACT)).cast("double").alias("got"),
                F.sum((F.col("n") * F.col("size") * x * w * (1 - w / F.lit(cap))).cast(EXACT)).cast("double").alias("slope"),
            )
        )
        off = F.col("got") - F.col("target")
        lo = F.when(off < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(off < 0, F.col("hi")).otherwise(F.col("lam"))
        newton = F.col("lam") - F.least(F.greatest(off / F.col("slope"), F.lit(-4.0)), F.lit(4.0))
        # A step out of the bracket, or on a flat dual, is a bisection.
        step = F.when((F.col("slope") > 0) & (newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        settled = (F.abs(off) <= F.lit(1e-9) * F.col("target") + 1e-6) | (hi - lo < 1e-12)
        nxt = scratch.save(
            now.join(sums, KEY, "left").select(
                *KEY, "target", "source_size", "mean",
                F.when(F.col("done") | settled, F.col("lam")).otherwise(step).alias("lam"),
                F.when(F.col("done"), F.col("lo")).otherwise(lo).alias("lo"),
                F.when(F.col("done"), F.col("hi")).otherwise(hi).alias("hi"),
                (F.col("done") | F.coalesce(settled, F.lit(True))).alias("done"),
            )
        )
        scratch.free(now)
        now = nxt
    else:
        raise RuntimeError("the weights of some sources did not settle")
    return now


def _copies(classes: DataFrame, cap: float) -> DataFrame:
    """(s_null, s, size, n, copies): whole copies for each class of equal documents of a source.

    The classes of a source, one row for each distinct size, are folded from the longest
    to the shortest with the error so far and with what shorter documents can still make up
    for; their number is bounded by the longest text, not by the number of documents."""
    def step(acc: Column, x: Column) -> Column:
        wanted = x["n"] * x["rate"] + acc["off"] / x["size"]
        clip = lambda k: F.greatest(F.lit(0.0), F.least(k, F.lit(float(cap)) * x["n"]))
        low, high = clip(F.floor(wanted).cast("double")), clip(F.floor(wanted).cast("double") + 1)
        # What a choice costs: tokens too many, or more than shorter documents can make up for.
        cost = lambda k: F.greatest(k * x["size"] - acc["left"], acc["left"] - k * x["size"] - F.lit(float(cap)) * (acc["rest"] - x["n"] * x["size"]), F.lit(0.5))
        k = F.when((cost(low) < cost(high)) | (cost(low) == cost(high)) & (wanted - low <= high - wanted), low).otherwise(high)
        done = F.struct((-x["neg"]).alias("size"), x["n"].alias("n"), k.cast("long").alias("copies"))
        return F.struct(
            (acc["off"] + (x["n"] * x["rate"] - k) * x["size"]).alias("off"),
            (acc["left"] - k * x["size"]).alias("left"),
            (acc["rest"] - x["n"] * x["size"]).alias("rest"),
            F.concat(acc["out"], F.array(done)).alias("out"),
        )

    empty = F.array().cast("array<struct<size:bigint,n:bigint,copies:bigint>>")
    rows = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("neg"), F.col("size").cast("double").alias("size"), "n", "rate")))

    def fold(acc: Column, block: Column) -> Column:
        start = F.struct(acc["off"].alias("off"), acc["left"].alias("left"), acc["rest"].alias("rest"), empty.alias("out"))
        done = F.aggregate(block, start, step)
        return F.struct(done["off"].alias("off"), done["left"].alias("left"), done["rest"].alias("rest"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    # Folded a block at a time: what is done so far is copied for each block, not for each class.
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / FOLD).cast("int")), lambda i: F.slice("rows", i * FOLD + 1, F.lit(FOLD)))
    start = F.struct(F.lit(0.0).alias("off"), F.col("target").alias("left"), F.col("source_size").alias("rest"), F.array().cast("array<array<struct<size:bigint,n:bigint,copies:bigint>>>").alias("out"))
    return (
        classes.where("size > 0")
        .groupBy(*KEY)
        .agg(rows.alias("rows"), F.max("target").alias("target"), F.max("source_size").cast("double").alias("source_size"))
        .select(*KEY, F.explode(F.flatten(F.aggregate(cut, start, fold, lambda a: a["out"]))).alias("c"))
        .select(*KEY, "c.*")
    )


def mix_sources(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, rate, mark (a
    hash of the text).

    Null text has size 0 and is never taken; null is a source of its own; sources whose
    documents are all empty have target 0.  Repeated rows count as documents each.  An
    empty table gives no rows."""
    scratch = Scratch(docs.sparkSession)
    sized = scratch.save(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).isNull().alias("s_null"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.col(text_col).cast("string")).alias("mark"),
            F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(PARTS)).alias("part"),
        )
    )
    parts = scratch.save(sized.groupBy(*KEY, "size", "part").agg(F.count("*").alias("m")))
    classes = scratch.save(parts.groupBy(*KEY, "size").agg(F.sum("m").alias("n")))
    sources = classes.groupBy(*KEY).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    targets = target_table(sources.drop("docs"), weights, float(cap)).join(sources.select(*KEY, "docs"), KEY)
    targets = targets.withColumn("mean", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9))).drop("docs")
    solved = _solve(classes, targets, scratch, float(cap))
    rated = classes.join(solved.select(*KEY, "target", "source_size", "mean", "lam"), KEY).withColumn("rate", _rate(F.col("lam"), F.col("size") / F.col("mean"), float(cap)))
    rated = scratch.save(rated)
    dealt = rated.select(*KEY, "size", "n", "rate", "source_size", "target").join(_copies(rated, cap).drop("n"), [*KEY, "size"], "left")
    # Documents of a class are ranked within its parts; a part knows how many stand before it.
    before = Window.partitionBy(*KEY, "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    dealt = parts.withColumn("base", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m").join(dealt, [*KEY, "size"])
    order = Window.partitionBy(*KEY, "size", "part").orderBy(F.xxhash64("doc_id"), "doc_id", "mark")
    ranked = sized.join(dealt, [*KEY, "size", "part"]).withColumn("rn", F.row_number().over(order) - 1)
    over = F.coalesce("copies", F.lit(0)) % F.col("n")
    copies = F.floor(F.coalesce("copies", F.lit(0)) / F.col("n")).cast("long") + (F.col("base") + F.col("rn") < over).cast("long")
    return ranked.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "rate", "mark")


def apply_mix(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The columns of ``docs``, each row as often as the mix takes it.  Rows that share id and
    text share their copies evenly, those with the smaller hash of all columns first, so
    reruns agree.  Columns may have any names; an empty table gives no rows."""
    scratch = Scratch(docs.sparkSession)
    mixed = mix_sources(docs, weights, cap, id_col, text_col, source_col)
    taken = mixed.groupBy(F.col("doc_id").alias("id"), "mark").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    # Written: texts then meet a plain table, which Spark knows the size of.
    taken = scratch.save(taken.where("copies > 0"))
    rows, names, named = plain_names(docs, doc=F.col(id_col).cast("long"), hash=F.xxhash64(F.col(text_col).cast("string")))

    def times(copies: Column, out: DataFrame) -> DataFrame:
        return out.select(*names, F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy")).select(*names)

    def meet(some: DataFrame) -> DataFrame:
        return rows.join(some, rows["doc"].eqNullSafe(some["id"]) & (rows["hash"] == some["mark"]))

    out = times(F.col("copies"), meet(taken.where("rows = 1")))
    repeated = taken.where("rows > 1")
    if repeated.limit(1).count():
        # Only rows that share id and text are ranked.
        nth = F.row_number().over(Window.partitionBy("id", "mark").orderBy(row_hash(names))) - 1
        share = F.floor(F.col("copies") / F.col("rows")) + (F.col("nth") < F.col("copies") % F.col("rows")).cast("long")
        out = out.unionByName(times(F.col("share"), meet(repeated).withColumn("nth", nth).withColumn("share", share).where("share > 0")))
    return named(out)


TARGETS_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)) AS weight FROM s
), r AS (
  SELECT *, 3 * source_size / weight AS ratio, sum(source_size) OVER () AS total FROM w
), l AS (
  SELECT *, (total - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM r
), t AS (
  SELECT source, source_size, least(3 * source_size, coalesce(weight * max(lvl) FILTER (lvl <= ratio) OVER (), 3 * source_size)) AS target FROM l
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(CAST(target AS DOUBLE), 3) AS target
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
