"""Causal filters: two-pole sections in cascade, computed block by block.

A section's state after a sample is a linear function of its state before and of the sample,
so a whole cascade over a block is: output = response to the block alone + response to the
state it starts with.  Pass 1 finds for each block the state it ends with from rest; a small
table (one row a block) carries states from block to block; pass 2 computes every block from
its true state.  No task holds more than a block, however long the recording.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators.blocks import neighbours
from wavemill.recording import SERIES, RecordingError, finite

MODES = ("lowpass", "highpass", "bandpass", "bandstop")
# Quality factors of the families.
QUALITY = {"butterworth": 0.70710678118654752440, "bessel": 0.57735026918962576451, "chebyshev": 0.92, "linkwitz_riley": 0.70710678118654752440}
RESET_STEPS = 64  # an interval beyond this many steps starts afresh
CHUNK = 64
BLOCK = 1 << 16


@dataclass(frozen=True)
class FilterSettings:
    mode: str = "lowpass"
    family: str = "butterworth"
    low: float = -math.inf  # cutoff of the high-pass part, Hz
    high: float = math.inf  # cutoff of the low-pass part, Hz
    step: float = 0.0  # seconds between samples; 0 or not finite: samples pass unchanged

    def __post_init__(self):
        if self.mode not in MODES or self.family not in QUALITY:
            raise RecordingError("InvalidOptions", f"unknown filter {self.family} {self.mode}")


def section(kind: str, q: float, cutoff: float, rate: float) -> tuple[float, ...]:
    """(b0, b1, b2, a1, a2) of a second-order section by the bilinear transform."""
    if not (rate > 0 and cutoff > 0 and math.isfinite(cutoff)):
        return 1.0, 0.0, 0.0, 0.0, 0.0
    w = 2 * math.pi * min(cutoff, 0.499 * rate) / rate
    c, alpha = math.cos(w), math.sin(w) / (2 * q)
    mid, edge = (1 - c, (1 - c) / 2) if kind == "lowpass" else (-(1 + c), (1 + c) / 2)
    a0 = 1 + alpha
    return edge / a0, mid / a0, edge / a0, -2 * c / a0, (1 - alpha) / a0


def cascade(s: FilterSettings) -> tuple[list[tuple[float, ...]], bool]:
    """The sections in order, and whether their output is subtracted from the input.

    A cutoff that isn't finite counts as 0; a high-pass at 0 and a low-pass at half the rate
    or more are left out."""
    rate, nyquist = 1 / s.step, 0.5 / s.step
    low, high = (min(max(f, 0.0), nyquist) if math.isfinite(f) else 0.0 for f in (s.low, s.high))
    q, twice = QUALITY[s.family], 2 if s.family == "linkwitz_riley" else 1
    up = [section("highpass", q, low, rate)] * twice if low > 0 else []
    down = [section("lowpass", q, high, rate)] * twice if high < nyquist else []
    return {"lowpass": down, "highpass": up, "bandpass": up + down, "bandstop": up + down}[s.mode], s.mode == "bandstop"


def run_sections(sections, x, state):
    """Sample by sample; ``state`` (two numbers a section) is changed in place."""
    out = np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        for k, (b0, b1, b2, a1, a2) in enumerate(sections):
            y = b0 * v + state[2 * k]
            state[2 * k] = b1 * v - a1 * y + state[2 * k + 1]
            state[2 * k + 1] = b2 * v - a2 * y
            v = y
        out[i] = v
    return out


class Linear:
    """The cascade over CHUNK samples as matrices."""

    def __init__(self, sections):
        self.sections, n = sections, 2 * len(sections)
        unit = np.zeros(n)
        impulse = np.zeros(CHUNK)
        impulse[0] = 1.0
        h = run_sections(sections, impulse, unit.copy())
        i = np.arange(CHUNK)
        self.h = np.where(i[:, None] >= i, h[np.abs(i[:, None] - i)], 0.0)  # output from input
        self.o, self.a, self.one = np.zeros((CHUNK, n)), np.zeros((n, n)), np.zeros((n, n))
        for k in range(n):
            z = unit.copy()
            z[k] = 1.0
            self.one[:, k] = self._after(z)
            self.o[:, k] = run_sections(sections, np.zeros(CHUNK), z)
            self.a[:, k] = z
        # State after a chunk from an impulse at each of its places.
        b = unit.copy()
        run_sections(sections, np.ones(1), b)
        self.c = np.stack([np.linalg.matrix_power(self.one, CHUNK - 1 - j) @ b for j in range(CHUNK)], 1)

    def _after(self, z):
        z = z.copy()
        run_sections(self.sections, np.zeros(1), z)
        return z

    def run(self, x, state):
        """Output for x from a state, and the state after it."""
        full = len(x) // CHUNK
        out = np.empty(len(x))
        if full:
            parts = x[: full * CHUNK].reshape(full, CHUNK)
            ends = parts @ self.c.T
            states = np.empty((full, len(state)))
            for k in range(full):
                states[k] = state
                state = self.a @ state + ends[k]
            out[: full * CHUNK] = (parts @ self.h.T + states @ self.o.T).reshape(-1)
        state = np.array(state, float)
        out[full * CHUNK :] = run_sections(self.sections, x[full * CHUNK :], state)
        return out, state


def _runs(reset: np.ndarray) -> list[tuple[int, int]]:
    starts = sorted({0, *np.flatnonzero(reset).tolist()})
    return list(zip(starts, [*starts[1:], len(reset)]))


def with_resets(long: DataFrame, step: float) -> DataFrame:
    """Adds ok (value and t are finite) and reset (the filter starts afresh here)."""
    ok = finite(F.col("value")) & finite(F.col("t"))
    rows = neighbours(long.withColumn("ok", ok), {"__t": ("t", -1), "__ok": ("ok", -1)})
    dt = F.col("t") - F.col("__t")
    reset = F.coalesce(~F.col("__ok") | (dt <= 0) | (dt > RESET_STEPS * step), F.lit(True)) | ~F.col("ok")
    return rows.withColumn("reset", reset).drop("__t", "__ok")


STATES = "recording_id string, channel string, block long, start array<double>"


def _unchanged(long: DataFrame, settings: FilterSettings) -> DataFrame | None:
    """The result where there is nothing to run: no step, or no sections."""
    if not (settings.step > 0 and math.isfinite(settings.step)):
        return long
    sections, subtract = cascade(settings)
    if not sections:
        return long.withColumn("value", F.when(finite(F.col("value")) & finite(F.col("t")), 0.0).otherwise(F.col("value"))) if subtract else long
    return None


def block_rows(long: DataFrame, settings: FilterSettings, block: int = BLOCK) -> DataFrame:
    """The recording with ok, reset and the number of each sample's block."""
    return with_resets(long, settings.step).withColumn("block", F.floor(F.col("sample") / block).cast("long"))


def block_states(rows: DataFrame, settings: FilterSettings) -> DataFrame:
    """(recording_id, channel, block, start): the state before each block, from ``block_rows``."""
    sections = cascade(settings)[0]
    linear, n, keys = Linear(sections), 2 * len(sections), [*SERIES, "block"]

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        begin = _runs(pdf["reset"].to_numpy(bool))[-1][0]
        x = pdf["value"].to_numpy(float)[begin:]
        state = linear.run(x, np.zeros(n))[1] if pdf["ok"].iloc[-1] else np.zeros(n)
        carries = begin == 0 and not pdf["reset"].iloc[0]
        return pd.DataFrame([[*pdf.iloc[0][list(SERIES)], int(pdf["block"].iloc[0]), len(pdf), carries, state.tolist()]], columns=[*keys, "n", "carries", "state"])

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, out = pdf.sort_values("block"), np.zeros(n), []
        for length, carries, end in zip(pdf["n"], pdf["carries"], pdf["state"]):
            out.append(state.tolist())
            state = np.array(end) + (np.linalg.matrix_power(linear.one, int(length)) @ state if carries else 0)
        return pdf[keys].assign(start=out)

    state = rows.groupBy(*keys).applyInPandas(ends, "recording_id string, channel string, block long, n long, carries boolean, state array<double>")
    return state.groupBy(*SERIES).applyInPandas(carry, STATES)


def run_blocks(rows: DataFrame, states: DataFrame, settings: FilterSettings, columns: list[str]) -> DataFrame:
    """The filtered samples of these blocks, each from its state."""
    sections, subtract = cascade(settings)
    linear, n, keys = Linear(sections), 2 * len(sections), [*SERIES, "block"]

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        x, ok, reset = pdf["value"].to_numpy(float), pdf["ok"].to_numpy(bool), pdf["reset"].to_numpy(bool)
        out = x.copy()
        for a, b in _runs(reset):
            if ok[a]:
                start = np.zeros(n) if reset[a] else np.array(pdf["start"].iloc[0])
                y = linear.run(x[a:b], start)[0]
                out[a:b] = x[a:b] - y if subtract else y
        pdf["value"] = out
        return pdf[columns]

    out = rows.join(states, keys).groupBy(*keys).applyInPandas(apply, rows.select(*columns).schema)
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def filter_channels(long: DataFrame, settings: FilterSettings, block: int = BLOCK) -> DataFrame:
    """Replaces value by the filtered value.

    Missing and infinite samples pass unchanged and start the filter afresh, as do times that
    don't advance and intervals of more than 64 steps."""
    out = _unchanged(long, settings)
    if out is not None:
        return out
    rows = block_rows(long, settings, block)
    return run_blocks(rows, block_states(rows, settings), settings, list(long.columns))
