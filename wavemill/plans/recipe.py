"""A whole analysis as one declarative value, and the command line over it.

Whatever the order in which options are given, a recipe reads, drops channels that repeat the
time axis, makes times monotonic, keeps an interval and some channels, applies formulas and
the filter, and then describes, exports or transforms the result.  Formulas and the filter
run before the interval is cut, so the filter is settled where the interval begins.
"""

from __future__ import annotations

import argparse
import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.functions.formula import FormulaError, compose
from wavemill.operators import spectrum, stats
from wavemill.operators.filter_states import FilterStates
from wavemill.operators.filters import FilterSettings, filter_channels
from wavemill.recording import RecordingError
from wavemill.sources import export
from wavemill.sources.recording_file import indexed, read_recording


@dataclass(frozen=True)
class Recipe:
    start: float | None = None
    end: float | None = None
    channels: tuple[str, ...] = ()
    global_formula: str | None = None
    formulas: dict[str, str] = field(default_factory=dict)
    filter: FilterSettings | None = None

    def apply(self, long: DataFrame, states: FilterStates | None = None, stamp: str = "") -> DataFrame:
        """The recording after the recipe.  With stored filter states (of a source in the state
        ``stamp``) only the blocks that meet the interval are filtered; the first use makes them."""
        if self.channels:
            long = long.where(F.col("channel").isin(*self.channels))
        value = compose(self.global_formula, None, F.col("value")) if self.global_formula else F.col("value")
        for channel, text in self.formulas.items():
            value = F.when(F.col("channel") == channel, compose(self.global_formula, text, F.col("value"))).otherwise(value)
        if self.global_formula or self.formulas:
            long = long.withColumn("value", value)
        if self.filter and states:
            steps = repr((sorted(self.channels), self.global_formula, sorted(self.formulas.items())))
            return stats.time_range(states.filter_interval(long, self.filter, stamp, self.start, self.end, steps), self.start, self.end)
        if self.filter:
            long = filter_channels(long, self.filter)
        return stats.time_range(long, self.start, self.end)


def _finite(text: str) -> float:
    value = float(text.replace(",", "."))
    if not math.isfinite(value):
        raise argparse.ArgumentTypeError("must be finite")
    return value


def _at_least(low: int):
    def read(text: str) -> int:
        value = int(text)
        if value < low:
            raise argparse.ArgumentTypeError(f"must be at least {low}")
        return value

    return read


def _samples(text: str) -> int:
    value = int(text)
    if value != 0 and value < 4:
        raise argparse.ArgumentTypeError("must be 0 or at least 4")
    return value


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wavemill", description="Describe, export and transform a recording.")
    p.add_argument("file")
    p.add_argument("-i", "--info", action="store_true", help="rows, channels and bounds")
    p.add_argument("-s", "--stats", action="store_true", help="count, bounds and mean of each channel")
    p.add_argument("-H", "--head", type=_at_least(0), metavar="N", help="the first N rows")
    p.add_argument("-c", "--csv", metavar="FILE", help="export as CSV")
    p.add_argument("--fft", action="store_true", help="spectral peaks")
    p.add_argument("--fft-csv", metavar="FILE", help="export amplitudes as CSV")
    p.add_argument("--peaks", type=_at_least(1), default=5, metavar="N")
    p.add_argument("--fft-samples", type=_samples, default=0, metavar="N", help="use the first N samples only")
    p.add_argument("--start", type=_finite, metavar="T")
    p.add_argument("--end", type=_finite, metavar="T")
    p.add_argument("--channels", metavar="LIST", help="positions from 1, by commas")
    p.add_argument("-m", "--monotonic", action="store_true", help="make times strictly increasing")
    p.add_argument("--keep-dup-time", action="store_true", help="keep channels that repeat the time")
    return p


def run(argv: Sequence[str], spark: SparkSession | None = None, out=sys.stdout) -> int:
    """The command line; 0: done, 1: it failed, 2: it was misused."""
    try:
        a = arguments().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = spark or SparkSession.builder.appName("wavemill").getOrCreate()
    try:
        index = indexed(spark, a.file, a.monotonic)
        if not index.data_rows:
            raise RecordingError("TooShort", "no numeric data")
        kept = index.channels(a.keep_dup_time)
        names = [n for _, n in kept]
        positions = [int(x) for x in a.channels.split(",")] if a.channels else list(range(1, len(names) + 1))
        chosen = stats.channel_positions(names, positions)
        long = read_recording(spark, a.file, monotonic=a.monotonic, keep_duplicate_time=a.keep_dup_time).drop("raw_t")
        long = Recipe(a.start, a.end, tuple(dict.fromkeys(chosen))).apply(long)
        if not long.limit(1).count():
            raise RecordingError("TooShort", "no data in the selected time range")
        # Samples of an interval count from 0 again.
        first = long.agg(F.min("sample")).first()[0]
        long = long.withColumn("sample", F.col("sample") - first).cache()
        axis = "Frequency" if index.frequency_axis else "Time"
        if a.info or not (a.stats or a.head is not None or a.csv or a.fft or a.fft_csv):
            for k, v in (index.counts() | stats.recording_info(long).first().asDict()).items():
                print(f"{k}: {export.number(v, 12) if isinstance(v, float) else v}", file=out)
        if a.stats:
            got = {r["channel"]: r for r in stats.channel_stats(long).collect()}
            for c in chosen:
                r = got[c]
                print(c, r["n"], *(export.number(r[k], 12) for k in ("min_value", "max_value", "mean_value")), sep="\t", file=out)
        if a.head is not None:
            print(axis, *chosen, sep="\t", file=out)
            for t, *values in export.table_rows(export.long_to_wide(stats.head(long, a.head), list(dict.fromkeys(chosen))), chosen).collect():
                print(*(export.number(v, 12) for v in (t, *values)), sep="\t", file=out)
        if a.csv:
            export.write_file(long, a.csv, chosen, source=a.file)
        if a.fft or a.fft_csv:
            s = spectrum.import_spectrum(long) if index.frequency_axis else spectrum.amplitude_spectrum(long, a.fft_samples)
            if a.fft_csv:
                export.write_spectrum_file(s, a.fft_csv, chosen)
            if a.fft:
                for r in spectrum.find_peaks(s, a.peaks).orderBy("channel", "rank").collect():
                    print(r["channel"], r["rank"], export.number(r["freq"], 12), export.number(r["amp"], 12), sep="\t", file=out)
    except (RecordingError, FormulaError, OSError) as e:
        print(f"wavemill: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
