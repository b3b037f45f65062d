"""Scalar helpers: numeric text, axis mappings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# A whole cell that is a decimal number; suffixes such as 1d or 1f are not numbers here.
DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_number(text: Column) -> Column:
    """A number with dot or comma as decimal mark; null for anything else and beyond range."""
    dotted = F.translate(F.trim(text), ",", ".")
    value = F.when(dotted.rlike(DECIMAL), dotted.try_cast("double"))
    return F.when(F.abs(value) != float("inf"), value)


def frequency_at(fraction: Column, lo: float, hi: float, logarithmic: bool) -> Column:
    """The frequency at a fraction of an axis from lo to hi."""
    if logarithmic:
        return F.pow(F.lit(10.0), F.lit(math.log10(lo)) + fraction * (math.log10(hi) - math.log10(lo)))
    return F.lit(lo) + fraction * (hi - lo)


def fraction_at(frequency: Column, lo: float, hi: float, logarithmic: bool) -> Column:
    if logarithmic:
        return (F.log10(frequency) - math.log10(lo)) / (math.log10(hi) - math.log10(lo))
    return (frequency - lo) / (hi - lo)


def slider_to_cutoff(fraction: Column, nyquist: float, gamma: float = 3.0) -> Column:
    """A cutoff for a slider's position, finer at low frequencies."""
    return nyquist * F.pow(F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0)), gamma)


def cutoff_to_slider(hz: Column, nyquist: float, gamma: float = 3.0) -> Column:
    return F.pow(F.least(F.greatest(hz / nyquist, F.lit(0.0)), F.lit(1.0)), 1.0 / gamma)
