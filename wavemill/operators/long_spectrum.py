"""Spectra of channels that are too long for one task: the four-step transform.

A transform of m = r * c samples is done on a matrix of r rows and c columns: columns are transformed and turned by
twiddle factors, the matrix changes hands (one shuffle of blocks), and rows are transformed.  A task holds
as many whole columns, or rows, as ``limit`` samples allow, and one at least.  Lengths without
two divisors up to the limit (large primes) go through the chirp transform: the spectrum
is a convolution with a chirp, done with two such transforms of a power of two; between
them rows are multiplied where they lie, so that there is one shuffle more.

The plan of a length is made by executors and joined to the rows; channels of all lengths
are transformed by the same job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.recording import SERIES, RecordingError
from wavemill.scratch import settle

SPECTRUM = "recording_id string, channel string, bin long, freq double, amp double"
PLAN = "n long, r long, c long, g long, h long, chirp boolean"
FACTS = ("n", "r", "c", "g", "h", "grid")
BLOCKS = "recording_id string, channel string, n long, r long, c long, g long, h long, grid double, grp long, at long, block binary, other binary"


def plan(n: int, limit: int) -> tuple[int, int, int, int, bool]:
    """Rows, columns, columns a task, rows a task, and whether a chirp is needed, for n samples."""
    for r in range(math.isqrt(n), 0, -1):
        if n // r > limit:
            break
        if n % r == 0:
            return r, n // r, max(1, limit // r), max(1, limit // (n // r)), False
    power = (2 * n - 2).bit_length()  # 2**power is 2n - 1 or more
    r, c = 1 << power // 2, 1 << power - power // 2
    if c > limit:
        raise RecordingError("ResourceLimit", f"a transform of {n} samples needs tasks of {c} samples")
    return r, c, max(1, limit // r), max(1, limit // c), True


def room(n: int, limit: int) -> int:
    """The samples a task may take of n: ``limit``, or where that holds no whole row or column, or leaves blocks of
    fewer than 16 samples to change hands, 64 of the longest that the chirp has, which grows with the root of n."""
    try:
        r, c, g, h, _ = plan(n, limit)
        if min(g, c) * min(h, r) >= 16:
            return limit
    except RecordingError:
        pass
    power = (2 * n - 2).bit_length()
    return max(limit, 64 << power - power // 2)


def _plans(limit: int):
    def run(batches):
        for batch in batches:
            ns = batch.column("n").to_pylist()
            rows = [(n, *plan(n, room(n, limit))) for n in ns]
            names = [c.split()[0] for c in PLAN.split(", ")]
            yield pa.RecordBatch.from_pydict({name: [r[k] for r in rows] for k, name in enumerate(names)})

    return run


def _groups(batches, keys) -> Iterator[pa.Table]:
    """Rows come sorted by these keys; each group's rows, of which a task holds one group at a time."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(k).dictionary_encode().indices.to_numpy() for k in keys]
        starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], axis=0)])).tolist()
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(batch.column(k)[lo].as_py() for k in keys)
            if key != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _turn(rows, columns, m: int, sign: float) -> np.ndarray:
    """exp(sign * 2 pi i * row * column / m), the product reduced as an integer first."""
    return np.exp(sign * 2j * np.pi * ((rows[:, None] * columns[None, :]) % m) / m)


def _chirp(at: np.ndarray, n: int) -> np.ndarray:
    """exp(pi i at^2 / n); squares are taken modulo 2n before they are numbers."""
    at = at.astype(object) if n >= 1 << 31 else at
    return np.exp(1j * np.pi * (at * at % (2 * n)).astype(np.float64) / n)


def _send(first: dict, blocks, width: int, at: int) -> Iterator[pa.RecordBatch]:
    """A row for each group of ``width`` rows of the blocks (one or two matrices)."""
    for k, lo in enumerate(range(0, len(blocks[0]), width)):
        raw = [np.ascontiguousarray(b[lo : lo + width]).tobytes() for b in blocks]
        row = {c: [first[c]] for c in (*SERIES, *FACTS)} | {"grp": [k], "at": [at], "block": [raw[0]], "other": [raw[1] if len(raw) > 1 else None]}
        schema = pa.schema([(c, pa.string()) for c in SERIES] + [(c, pa.int64()) for c in FACTS[:-1]] + [("grid", pa.float64()), ("grp", pa.int64()), ("at", pa.int64()), ("block", pa.binary()), ("other", pa.binary())])
        yield pa.RecordBatch.from_pydict(row, schema)


def _columns(chirp: bool):
    """Transforms groups of columns of the samples (and of the chirp) and deals them by rows."""

    def run(batches):
        for t in _groups(batches, (*SERIES, "grp")):
            first = t.slice(0, 1).to_pylist()[0]
            n, r, c, g, h = (first[k] for k in FACTS[:-1])
            at, m = first["grp"] * g, r * c
            columns = np.arange(at, min(at + g, c))
            place = t.column("sample").to_numpy()
            value = t.column("value").to_numpy() - first["mean"]
            x = np.zeros((r, len(columns)), complex)
            x[place // c, place % c - at] = value * np.conj(_chirp(place, n)) if chirp else value
            turn = _turn(np.arange(r), columns, m, -1.0)
            blocks = [np.fft.fft(x, axis=0) * turn]
            if chirp:
                index = np.arange(r)[:, None] * c + columns[None, :]
                index = np.minimum(index, m - index)
                wave = np.where(index < n, _chirp(np.minimum(index, n), n), 0)
                blocks.append(np.fft.fft(wave, axis=0) * turn)
            yield from _send(first, blocks, h, at)

    return run


def _gather(t: pa.Table, name: str, high: int) -> np.ndarray:
    """A group's blocks of so many rows, which come in the order of their places, side by side."""
    return np.concatenate([np.frombuffer(b, complex).reshape(high, -1) for b in t.column(name).to_pylist()], axis=1)


def _bins(first: dict, k: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    n = first["n"]
    k, size = k.reshape(-1), np.abs(x).reshape(-1)
    some = k <= n // 2
    k, size = k[some], size[some] * (2.0 / n)
    size = np.where(k == 0, 0.0, np.where(2 * k == n, size / 2, size))
    names = [pa.repeat(pa.scalar(first[s], pa.string()), len(k)) for s in SERIES]
    return pa.RecordBatch.from_arrays([*names, pa.array(k, pa.int64()), pa.array(k / (n * first["grid"])), pa.array(size)], names=["recording_id", "channel", "bin", "freq", "amp"])


def _rows(batches):
    """Transforms groups of rows, which gives the bins."""
    for t in _groups(batches, (*SERIES, "grp")):
        first = t.slice(0, 1).to_pylist()[0]
        r, c, h = first["r"], first["c"], first["h"]
        rows = np.arange(first["grp"] * h, min((first["grp"] + 1) * h, r))
        x = np.fft.fft(_gather(t, "block", len(rows)), axis=1)
        yield _bins(first, rows[:, None] + r * np.arange(c)[None, :], x)


def _convolved(batches):
    """Transforms groups of rows of samples and chirp, multiplies them and begins the way back."""
    for t in _groups(batches, (*SERIES, "grp")):
        first = t.slice(0, 1).to_pylist()[0]
        r, c, g, h = (first[k] for k in ("r", "c", "g", "h"))
        rows = np.arange(first["grp"] * h, min((first["grp"] + 1) * h, r))
        both = np.fft.fft(_gather(t, "block", len(rows)), axis=1) * np.fft.fft(_gather(t, "other", len(rows)), axis=1)
        back = np.fft.ifft(both, axis=1) * _turn(rows, np.arange(c), r * c, 1.0)
        yield from _send(first, [back.T], g, int(rows[0]))


def _back(batches):
    """The other half of the way back; the chirp's own turn changes no amplitude."""
    for t in _groups(batches, (*SERIES, "grp")):
        first = t.slice(0, 1).to_pylist()[0]
        r, c, g = first["r"], first["c"], first["g"]
        columns = np.arange(first["grp"] * g, min((first["grp"] + 1) * g, c))
        x = np.fft.ifft(_gather(t, "block", len(columns)), axis=1)
        yield _bins(first, columns[:, None] + c * np.arange(r)[None, :], x)


def _dealt(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition(*SERIES, "grp").sortWithinPartitions(*SERIES, "grp", *order)


def long_spectrum(even: DataFrame, lengths: DataFrame, limit: int) -> DataFrame:
    """Amplitudes as those of ``amplitude_spectrum`` for (keys, sample, value, n, grid, mean): evenly
    spaced samples without missing ones; ``lengths`` holds their different n.  A task works on
    at most ``limit`` samples at a time, or on what room() gives to lengths too great for that."""
    plans = settle(lengths.mapInArrow(_plans(limit), PLAN))
    kinds = [r["chirp"] for r in plans.select("chirp").distinct().collect()]
    out = None
    for chirp in sorted(kinds):
        rows = even.join(plans.where(F.col("chirp") == chirp).drop("chirp"), "n")
        rows = rows.withColumn("grp", F.floor((F.col("sample") % F.col("c")) / F.col("g"))).select(*SERIES, *FACTS, "mean", "grp", "sample", "value")
        blocks = _dealt(rows).mapInArrow(_columns(chirp), BLOCKS)
        if chirp:
            blocks = _dealt(blocks, "at").mapInArrow(_convolved, BLOCKS)
        done = _dealt(blocks, "at").mapInArrow(_back if chirp else _rows, SPECTRUM)
        out = done if out is None else out.unionByName(done)
    return out
