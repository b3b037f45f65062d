"""Bounded comparison tiles: every pair of rows of a bucket meets in exactly one of them.

A bucket of up to ``tile`` rows is one tile.  A larger one is cut into blocks by a hash of
the row's id, and each pair of blocks is a tile of its own, so a task's memory doesn't grow
with the bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import Scratch


def deal_tiles(members: DataFrame, key: str, id_col: str, tile: int, scratch: Scratch, weight: str | None = None, limit: int = 0) -> DataFrame:
    """``members`` with columns tile_no and side, repartitioned and sorted so that the rows of
    a tile stand together, side 0 first.  With ``weight`` a block's weights add up to about
    ``limit`` at most, too.

    The tile of a block with itself has a negative number and rows of side 0 only.  Only
    buckets that are cut are listed (written, so that Spark knows how few they are)."""
    blocks = F.ceil(F.count("*") / F.lit(tile))
    if weight:
        blocks = F.greatest(blocks, F.ceil(F.sum(weight) / F.lit(limit)))
    large = scratch.save(members.groupBy(key).agg(blocks.cast("int").alias("__blocks")).where("__blocks > 1"))
    rows = members.join(large, key, "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    rows = rows.withColumn("__block", F.pmod(F.xxhash64(id_col), F.col("__blocks")).cast("int"))

    def pair(j):
        lo, hi = F.least(j, F.col("__block")), F.greatest(j, F.col("__block"))
        return F.struct(F.when(lo == hi, -1 - lo).otherwise(lo * F.col("__blocks") + hi).alias("tile_no"), F.when(j >= F.col("__block"), 0).otherwise(1).alias("side"))

    pairs = F.transform(F.sequence(F.lit(0), F.col("__blocks") - 1), pair)
    rows = rows.select(*members.columns, F.explode(pairs).alias("__x"))
    rows = rows.select(*members.columns, F.col("__x.tile_no").alias("tile_no"), F.col("__x.side").alias("side"))
    return rows.repartition(key, "tile_no").sortWithinPartitions(key, "tile_no", "side", id_col)


def runs(batches, key: str, values: dict):
    """Yields (within, arrays, n0) of each tile that has pairs.

    ``values`` maps the columns wanted to a function from an Arrow column to an array (or to
    None for plain numbers); ``arrays`` are theirs, the n0 rows of side 0 first.  Within: the
    rows are to be compared with each other, else those of side 0 with those of side 1."""
    now, held = None, []

    def ready():
        side = np.concatenate([h[0] for h in held])
        n0 = int((side == 0).sum())
        if n0 > 1 if now[1] < 0 else 0 < n0 < len(side):
            yield now[1] < 0, [np.concatenate([h[i] for h in held]) for i in range(1, len(values) + 1)], n0

    for batch in batches:
        if not batch.num_rows:
            continue
        k, t, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in (key, "tile_no", "side"))
        columns = [(f or (lambda c: c.to_numpy(zero_copy_only=False)))(batch.column(c)) for c, f in values.items()]
        cut = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]) | (t[1:] != t[:-1])) + 1, [len(k)]])
        # A row that is alone within its batch has no pair; at either end its tile may go on.
        some = np.diff(cut) > 1
        some[[0, -1]] = True
        for a, b in zip(cut[:-1][some].tolist(), cut[1:][some].tolist()):
            if (ident := (int(k[a]), int(t[a]))) != now:
                if held:
                    yield from ready()
                now, held = ident, []
            held.append([side[a:b], *(c[a:b] for c in columns)])
    if held:
        yield from ready()


class Forest:
    """Links that connect what wasn't connected yet."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        r, s = self.root(x), self.root(y)
        self.parent[r] = s
        return r != s


def spanning_links(found, n0: int, n: int, within: bool, rows: int = 64) -> list[tuple[int, int]]:
    """Places (i, j) of links that connect whatever the links among the rows connect.

    ``found(lo, hi, columns)`` tells which rows lo to hi link to which columns, as a matrix.
    Rows that are connected already are not looked at again, so a tile of one large group is
    little work."""
    label, out = np.arange(n), []
    for lo in range(0, n0, rows):
        hi = min(lo + rows, n0)
        columns = np.arange(lo + 1 if within else n0, n)
        own = label[lo:hi]
        if (own == own[0]).all():
            columns = columns[label[columns] != own[0]]
        if not len(columns):
            continue
        links = found(lo, hi, columns)
        for i in range(lo, hi):
            if within and i > lo:
                links[i - lo, : np.searchsorted(columns, i, "right")] = False
            near = columns[links[i - lo]]
            near = near[label[near] != label[i]]
            if len(near):
                other, first = np.unique(label[near], return_index=True)
                out += [(i, int(j)) for j in near[first]]
                label[np.isin(label, other)] = label[i]
    return out
