"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.scratch import Scratch

__all__ = ["Scratch", "plain_names", "row_hash", "sift", "slices", "table", "word_count"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text):
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def slices(batches, rows: int = 1000):
    """Arrow batches in parts of so many rows, so that Python holds the objects of few texts
    at a time; the parts share the batch's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def plain_names(df: DataFrame, **more):
    """The table with its columns named c0, c1, ... and ``more`` columns besides, so that no name
    of the table's can clash with an operator's; and what gives the names back."""
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)), *(c.alias(n) for n, c in more.items()))
    return plain, names, lambda out: out.select(*(F.col(n).alias(c) for n, c in zip(names, df.columns)))


def row_hash(names):
    """A hash of these columns, which orders rows that share their keys."""
    return F.xxhash64(F.to_json(F.struct(*names)))


SLOTS = 1 << 18  # words of 64 bits in a sieve, whatever the table


def sift(rows: DataFrame, mark: str, listed: DataFrame, listed_mark: str) -> DataFrame:
    """``rows`` with ``maybe``: false only where the mark (a 64-bit hash) is not among the listed ones.

    A bitmap of SLOTS words, which is never larger, goes to all tasks, so that rows of few
    listed marks needn't be shuffled to find out about all the others."""
    slot, bit = F.pmod(F.shiftrightunsigned(F.col(listed_mark), 6), F.lit(SLOTS)), F.col(listed_mark).bitwiseAND(F.lit(63)).cast("int")
    sieve = listed.select(slot.alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("slot").agg(F.bit_or("b").alias("bits"))
    at = F.pmod(F.shiftrightunsigned(F.col(mark), 6), F.lit(SLOTS))
    found = rows.withColumn("slot", at).join(F.broadcast(sieve), "slot", "left")
    held = F.getbit("bits", F.col(mark).bitwiseAND(F.lit(63)).cast("int")) == 1
    return found.withColumn("maybe", F.coalesce(held, F.lit(False))).drop("slot", "bits")
