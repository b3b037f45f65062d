"""Recording files that are still being written, as a stream: ``spark.readStream.format("recording")``.

The options are those of the batch source, and ``max_bytes`` (of a file for each micro-batch; default 2**28).
``path`` may hold patterns; files that come later join in.  A micro-batch takes the complete rows
that its files have gained, cut into stretches of ``checkpoint`` rows for executors to read.

An offset holds for each file the byte behind its last row taken, the number of rows, the clock
(Clock: what the time of the next row depends on) and the channels, so a query that starts again
from its checkpoint goes on exactly there, and the rows are those of the batch source.
Channels are settled by the first micro-batch in which a file has rows: columns with a value and
other than the time's; a column whose first value comes later isn't among them.
A file that shrinks is an error (SourceChanged).  To find the clock behind new rows the driver's reader goes
through their bytes once.
"""

from __future__ import annotations

import glob
import math
import os
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSourceStreamReader

from wavemill.recording import RecordingError
from wavemill.sources.recording_file import Clock, Options, Stretch, read_stretch, register, scan, stretches

BLOCK = 1 << 16


def last_line_end(path: str, start: int, end: int) -> int:
    """The byte behind the last line break of start..end, or ``start`` if there is none."""
    with open(path, "rb") as f:
        while end > start:
            begin = max(start, end - BLOCK)
            f.seek(begin)
            if (at := f.read(end - begin).rfind(b"\n")) >= 0:
                return begin + at + 1
            end = begin
    return start


def next_line_end(path: str, start: int) -> int:
    """The byte behind the first line break from ``start`` on, or ``start`` if there is none."""
    with open(path, "rb") as f:
        f.seek(start)
        line = f.readline()
    return start + len(line) if line.endswith(b"\n") else start


def new_id(path: str, taken: set[str]) -> str:
    """The file's name, or as much of its path as tells it from the recordings there are."""
    parts = os.path.abspath(path).split(os.sep)
    return next((name for k in range(1, len(parts) + 1) if (name := "/".join(parts[-k:])) not in taken), path)


class RecordingStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options = Options(options)
        self.seen: dict = {"files": {}}  # the furthest offset this reader knows of
        self.plans: dict[tuple, list] = {}  # (path, first byte, last byte): places in between

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        files = dict(self.seen["files"])
        for path in sorted({p for pattern in self.options.paths for p in (glob.glob(pattern) or [pattern])}):
            if os.path.exists(path):
                files[path] = self._advance(path, files.get(path), {f["id"] for f in files.values()})
        self.seen = {"files": {p: f for p, f in files.items() if f}}
        return self.seen

    def _advance(self, path: str, now: dict | None, taken: set[str]) -> dict | None:
        """The file's offset behind the complete rows that it has gained."""
        o, start, size = self.options, now["byte"] if now else 0, os.path.getsize(path)
        if size < start:
            raise RecordingError("SourceChanged", f"{path} is shorter than what was read of it")
        until = last_line_end(path, start, min(size, start + o.max_bytes))
        if until == start and size > start + o.max_bytes:
            until = next_line_end(path, start)
        if until == start:
            return now
        return self._scan(path, now, until, taken)

    def _scan(self, path: str, now: dict | None, until: int, taken: set[str]) -> dict | None:
        o = self.options
        start = now["byte"] if now else 0
        clock = Clock(**now["clock"]) if now else Clock(monotonic=o.monotonic)
        first, markers, before = (now["rows"], now["markers"], now["t"]) if now else (0, 0, -math.inf)
        begin = (start, first, before, Clock(**asdict(clock)), markers)
        index = scan(path, o.monotonic, o.checkpoint, start=start, clock=clock, markers=markers, labelled=start > 0, until=until, whole_records=True, note_last=True)
        if not index.data_rows:
            # Nothing but headers so far: they are read again with the rows that follow them.
            return now
        byte, rows, t, clock, markers = index.places[-1]
        places = [(b, first + r, at, c, m) for b, r, at, c, m in index.places]
        self.plans[path, start, byte] = [begin, *places]
        columns = now["columns"] if now else index.channels(o.keep_duplicate_time)
        name = now["id"] if now else new_id(path, taken)
        return {"byte": byte, "rows": first + rows, "t": t, "clock": asdict(clock), "markers": markers, "columns": [list(c) for c in columns], "id": name}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.seen = self.seen if self._behind(end) else end
        out = []
        for path, to in end["files"].items():
            now = start["files"].get(path)
            if now == to:
                continue
            at = now["byte"] if now else 0
            if (path, at, to["byte"]) not in self.plans:
                # A batch that is run again after a start from the checkpoint.
                self._scan(path, now, to["byte"], set())
            places = self.plans[path, at, to["byte"]]
            columns = [tuple(c) for c in to["columns"]]
            out += stretches(self.options, path, to["id"], places, to["rows"], to["t"], columns, None)
        return out

    def _behind(self, end: dict) -> bool:
        """Whether this reader has already seen further than ``end``."""
        seen = self.seen["files"]
        return all(p in seen and seen[p]["byte"] >= f["byte"] for p, f in end["files"].items())

    def read(self, partition: Stretch):
        yield from read_stretch(partition)

    def commit(self, end: dict) -> None:
        upto = {p: f["byte"] for p, f in end["files"].items()}
        self.plans = {k: v for k, v in self.plans.items() if k[2] > upto.get(k[0], 0)}

    def stop(self) -> None:
        self.plans.clear()


def stream_recording(spark, *paths: str, **options) -> DataFrame:
    """The stream of long rows of files that grow; options as for the data source."""
    register(spark)
    reader = spark.readStream.format("recording").option("path", ",".join(paths))
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load()
