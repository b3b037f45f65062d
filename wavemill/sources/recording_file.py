"""Signal files as a Spark data source: ``spark.read.format("recording")``.

LabVIEW measurement files (.lvm), tab-separated text (.txt) and comma-separated text (.csv)
hold one time column and any number of channels.  A file's sections, clock and labels are a
state machine over its lines, so one pass notes the state at every CHECKPOINT rows (the index);
each stretch between notes is a partition that any executor reads alone.  ``read_recording``
makes the pass in Spark jobs over ranges of RANGE bytes: what section headers do to the clock is
a small function of each range, and so is what its rows do to the times; composing these gives the
state at every note.  Only CSV files with quotes in their body, and times that hardly increase,
are read through by one task.  Indexes are stored in the shared folder and hold for as long as
their file keeps its size and time.  Without an index the driver makes the pass.
``read_where`` hands a condition on t, sample, channel and recording_id to the source: it chooses
stretches, and cells of other channels are not parsed.  As a stream, see wavemill.streaming.recording_stream.
Paths must be readable on every node (a shared file system).

Long rows: recording_id, channel, sample, t, value (see wavemill.recording), and raw_t.
Options: ``path`` (several joined by commas), ``start``/``end`` (seconds, inclusive),
``monotonic`` (default true: times never stand still), ``channels`` (1-based, by commas),
``keep_duplicate_time`` (default false), ``checkpoint`` (rows for each partition), ``index`` (folder
of stored indexes).
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from wavemill.clock import MonotonicClock, Runs
from wavemill.recording import RecordingError
from wavemill.scratch import shared_dir
from wavemill.sources.numeric import METADATA_KEYS, channel_label, parse_cell, split_csv, split_tabs

SCHEMA = "recording_id string, channel string, sample long, t double, raw_t double, value double"
CHECKPOINT = 65_536
RANGE = 64 << 20
BOM = "\ufeff"
HEADER_END = "***End_of_Header***"
RUNS = 65_536  # stretches of increasing times that one range of bytes may hold
PARTS = 64  # partitions of a file, as long as these have CHECKPOINT rows at most


@dataclass
class Clock(MonotonicClock):
    """What the time of the next row depends on."""

    anchor: float | None = None  # seconds of the first dated section
    shift: float | None = None  # of the section under way, against the anchor, less its X0
    monotonic: bool = True

    def advance(self, raw: float) -> float:
        now = raw if self.shift is None else self.shift + raw
        return self.place(now) if self.monotonic else now


def section_seconds(date: str, clock: str) -> float | None:
    """Seconds of a LabVIEW date (year/month/day) and time of day, local time."""
    try:
        y, m, d = (int(x) for x in date.split("/")[:3])
        hh, mm, ss = clock.replace(",", ".").split(":")[:3]
        s = float(ss)
        return time.mktime((y, m, d, int(hh), int(mm), math.floor(s), 0, 0, -1)) + s - math.floor(s)
    except (ValueError, OverflowError):
        return None


# Comments that say what the rows are.
KINDS = ("data_kind=frf", "plot_mode=frequency")


@dataclass
class Index:
    """What one pass over a file has found."""

    labels: list[str] = field(default_factory=list)
    path: str = ""
    kinds: list[str] = field(default_factory=list)  # of KINDS, those that comments have named so far
    header_markers: int = 0
    data_sections: int = 0
    data_rows: int = 0
    max_columns: int = 0
    frequency_axis: bool = False
    valid: list[bool] = field(default_factory=list)  # columns with a value
    repeats_time: list[bool] = field(default_factory=list)
    bounds: tuple[float, float] | None = None
    places: list[tuple[int, int, float, Clock, int]] = field(default_factory=list)  # byte, row, t, clock, header markers
    stamp: tuple[int, int] = (0, 0)
    broken: bool = False  # a body that isn't rows alone
    end: int = 0  # the byte the pass has come to
    clock: Clock | None = None
    pending: dict[str, str] = field(default_factory=dict)  # metadata of the section to come
    section_open: bool = False  # the section under way has rows
    leading_rows: bool = False  # rows before the pass met a header

    @property
    def comments(self) -> list[str]:
        """The file's comments, which aren't kept but read again: they may be more than its rows."""
        if stamp(self.path) != self.stamp:
            raise RecordingError("SourceChanged", self.path)
        with open(self.path, "rb") as f:
            return [c for _, line, fields in _records(self.path, f, 0) if fields is None and line.startswith("#") and (c := line[1:].strip())]

    def counts(self) -> dict[str, int]:
        return {k: getattr(self, k) for k in ("header_markers", "data_sections", "data_rows", "max_columns")}

    def channels(self, keep_duplicate_time: bool = False) -> list[tuple[int, str]]:
        """(physical column, name) of the channels kept."""
        out = []
        for c in range(1, self.max_columns):
            if self.valid[c] and (keep_duplicate_time or self.frequency_axis or not self.repeats_time[c]):
                out.append((c, channel_label(self.labels[c] if c < len(self.labels) else "", len(out) + 1)[0]))
        return out


def stamp(path: str) -> tuple[int, int]:
    s = os.stat(path)
    return s.st_size, s.st_mtime_ns


def is_csv(path: str) -> bool:
    return path.lower().endswith(".csv")


def note_metadata(pending: dict[str, str], line: str) -> None:
    """Keeps what a metadata line says of the section that follows."""
    key, value = line.split("\t", 1)[0].strip(), (line.split("\t") + [""])[1].strip()
    if key in ("Date", "Time") and value:
        pending[key] = value
    elif key == "X0" and (x0 := parse_cell(value.replace(",", "."))[0]) is not None:
        pending[key] = repr(x0)


def section_start(pending: dict[str, str]) -> tuple[float, float] | None:
    """(seconds of its date, X0) of the section that these metadata lines begin, if it is dated."""
    if {"Date", "Time", "X0"} <= pending.keys() and (s := section_seconds(pending["Date"], pending["Time"])) is not None:
        return s, float(pending["X0"])
    return None


def begin_section(clock: Clock, start: tuple[float, float] | None) -> None:
    clock.shift = None
    if start:
        clock.anchor = start[0] if clock.anchor is None else clock.anchor
        clock.shift = start[0] - clock.anchor - start[1]


UNREAD = (None, False)


def read_cells(fields: list[str], wanted) -> list[tuple[float | None, bool]]:
    """The cells of a row, of which only the first one and the wanted ones are parsed, and as many more as it
    takes to see that two are numbers."""
    if wanted is None:
        return [parse_cell(c) for c in fields]
    cells, numbers = [UNREAD] * len(fields), 0
    for c in (0, *wanted):
        if c < len(fields):
            cells[c] = parse_cell(fields[c])
            numbers += cells[c][1]
    for c, text in enumerate(fields):
        if numbers >= 2:
            break
        if c and c not in wanted:
            cells[c] = parse_cell(text)
            numbers += cells[c][1]
    return cells


def _close(a: float, b: float) -> bool:
    return abs(a - b) <= 1e-12 + 1e-9 * abs(b)


def _lines(f, start: int):
    """(end byte, line without its break) from a byte on."""
    f.seek(start)
    at = start
    for raw in f:
        at += len(raw)
        text = raw.decode("utf-8", "replace").rstrip("\n").removesuffix("\r")
        yield at, text.removeprefix(BOM) if at == len(raw) else text


def _records(path, f, start, whole_records=False):
    """(end byte, line or None, fields or None): CSV records have fields, other lines text."""
    if not is_csv(path):
        for at, line in _lines(f, start):
            yield at, line, None
        return
    pending, end = None, start
    for end, line in _lines(f, start):
        if pending is None and (not line or line.startswith("#")):
            yield end, line, None
            continue
        pending = line if pending is None else pending + "\n" + line
        got = next(iter(_one(pending)), None)
        if got is not None:
            yield end, pending, got
            pending = None
    if pending is not None and not whole_records:
        raise RecordingError("InvalidOptions", "malformed CSV record: a quote is left open")


def _one(record):
    try:
        fields = split_csv(record)
    except ValueError as e:
        raise RecordingError("InvalidOptions", str(e)) from e
    return [] if fields is None else [fields]


def scan(path: str, monotonic: bool = True, checkpoint: int = CHECKPOINT, on_row=None, start: int = 0, clock: Clock | None = None, markers: int = 0, labelled: bool = False, rows: int | None = None, until: int | None = None, notes: bool = True, wanted=None, pending: dict[str, str] | None = None, whole_records: bool = False, note_last: bool = False, kinds: tuple[str, ...] = ()) -> Index:
    """One pass over a file, or from a noted place on over so many rows.

    ``on_row(raw_t, t, values)`` gets every row that counts: two numbers or more, the first
    of them finite.  ``until``: lines that start before that byte; ``notes``: whether to keep
    facts for an index; ``wanted``: columns whose cells are parsed (the others are None then);
    ``pending``: metadata lines that stand before ``start``; ``whole_records``: a record that a
    quote leaves open at the end is still being written, and no error; ``note_last``: the
    last row is noted as a place, too; ``kinds``: those that comments before ``start`` have named."""
    index, clock = Index(path=path, kinds=list(kinds), header_markers=markers, stamp=stamp(path)), clock or Clock(monotonic=monotonic)
    pending = dict(pending or {})
    metadata_seen, section_has_data = False, False
    with open(path, "rb") as f:
        begin = start
        for end, line, fields in _records(path, f, start, whole_records):
            if until is not None and begin >= until:
                break
            begin = index.end = end
            index.broken = index.broken or is_csv(path) and '"' in line and (labelled or index.data_rows > 0)
            if fields is None:
                if not line:
                    continue
                if line.startswith("#"):
                    if (comment := line[1:].strip()) in KINDS and comment not in index.kinds:
                        index.kinds.append(comment)
                    continue
                if line.startswith(HEADER_END):
                    index.header_markers += 1
                    section_has_data = metadata_seen = False
                    begin_section(clock, section_start(pending))
                    pending = {}
                    continue
                if line.startswith("***"):
                    continue
                fields = split_tabs(line)
            cells = read_cells(fields, wanted if labelled or index.labels else None)
            numbers = sum(ok for _, ok in cells)
            labels_open = not index.labels and not labelled and numbers == 0 and len(fields) > 1
            tabbed = not is_csv(path)
            if tabbed and index.header_markers and not metadata_seen and labels_open:
                index.labels = fields
                continue
            if tabbed and line.split("\t", 1)[0].strip() in METADATA_KEYS:
                metadata_seen = metadata_seen or index.header_markers > 0
                note_metadata(pending, line)
                continue
            if labels_open:
                index.labels = fields
                continue
            if numbers < 2 or cells[0][0] is None:
                continue
            raw, values = cells[0][0], [v for v, _ in cells]
            if not index.data_rows:
                if "data_kind=frf" in index.kinds:
                    raise RecordingError("FrequencyData", "the file holds a frequency response, not samples")
                index.frequency_axis = index.labels[:1] == ["Frequency"] or "plot_mode=frequency" in index.kinds
            t = raw if index.frequency_axis else clock.advance(raw)
            index.data_rows += 1
            index.leading_rows = index.leading_rows or index.header_markers == markers
            if not section_has_data:
                section_has_data, index.data_sections = True, index.data_sections + 1
            if on_row:
                if on_row(raw, t, values):
                    break
            if not notes:
                if index.data_rows == rows:
                    break
                continue
            index.bounds = (t if index.bounds is None else index.bounds[0], t)
            while index.max_columns < len(values):
                index.max_columns += 1
                index.valid.append(False)
                index.repeats_time.append(True)
            for c, v in enumerate(values):
                if v is not None:
                    index.valid[c] = True
                    index.repeats_time[c] = index.repeats_time[c] and _close(v, raw)
            if note_last:
                last, row_clock = (end, t, index.header_markers), replace(clock)
            if index.data_rows % checkpoint == 0:
                index.places.append((end, index.data_rows, t, replace(clock), index.header_markers))
            if index.data_rows == rows:
                break
    if note_last and notes and index.data_rows and index.data_rows % checkpoint:
        index.places.append((last[0], index.data_rows, last[1], row_clock, last[2]))
    index.clock, index.pending, index.section_open = clock, pending, section_has_data
    return index


def scan_time_bounds(path: str, monotonic: bool = True) -> tuple[float, float]:
    """First and last time of a file."""
    bounds = scan(path, monotonic).bounds
    if bounds is None:
        raise RecordingError("TooShort", "no numeric data")
    return bounds


def parse_stats(path: str) -> dict[str, int]:
    return scan(path).counts()


def recording_ids(paths: list[str]) -> dict[str, str]:
    """An id for each path: the file's name, or as many folders of its path as tell files of one name apart."""
    parts = {p: os.path.abspath(p).split(os.sep) for p in paths}
    out = {}
    for p, own in parts.items():
        for k in range(1, len(own) + 1):
            if sum(other[-k:] == own[-k:] for other in parts.values()) == 1:
                break
        out[p] = "/".join(own[-k:])
    return out


def to_json(index: Index) -> str:
    return json.dumps(asdict(index))


def from_json(text: str) -> Index:
    got = json.loads(text)
    got["places"] = [(b, r, t, Clock(**c), m) for b, r, t, c, m in got["places"]]
    got["bounds"] = got["bounds"] and tuple(got["bounds"])
    got["clock"] = got["clock"] and Clock(**got["clock"])
    return Index(**got | {"stamp": tuple(got["stamp"])})


def index_file(folder: str, path: str, monotonic: bool, checkpoint: int) -> str:
    """Where the index of a file, as it is now, is stored."""
    key = repr((os.path.abspath(path), stamp(path), monotonic, checkpoint, KINDS))
    return f"{folder}/{hashlib.sha256(key.encode()).hexdigest()[:40]}.json"


def load_index(folder: str | None, path: str, monotonic: bool, checkpoint: int) -> Index | None:
    try:
        with open(index_file(folder, path, monotonic, checkpoint), encoding="utf-8") as f:
            return from_json(f.read())
    except FileNotFoundError:
        return None


def store_index(folder: str, path: str, index: Index, monotonic: bool, checkpoint: int) -> None:
    os.makedirs(folder, exist_ok=True)
    name = index_file(folder, path, monotonic, checkpoint)
    with open(part := f"{name}.{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
        f.write(to_json(index))
    os.replace(part, name)


def line_start(path: str, byte: int) -> int:
    """The first line that starts at this byte or after it."""
    with open(path, "rb") as f:
        f.seek(byte - 1)
        return byte - 1 + len(f.readline())


def body_start(path: str, start: int, end: int) -> dict:
    """The first line of a range of bytes that is neither a comment nor empty (None: there is none), and the
    kinds that the comments before it name."""
    kinds: list[str] = []
    with open(path, "rb") as f:
        for at, raw in _raw_lines(f, line_start(path, start) if start else 0):
            if at >= end:
                break
            text = raw.removesuffix(b"\n").removesuffix(b"\r")
            text = text if at else text.removeprefix(BOM.encode())
            if text and not text.startswith(b"#"):
                return {"byte": at, "kinds": kinds}
            if (comment := text[1:].strip().decode("utf-8", "replace")) in KINDS and comment not in kinds:
                kinds.append(comment)
    return {"byte": None, "kinds": kinds}


def first_rows(path: str, parts: dict[int, dict], monotonic: bool, checkpoint: int) -> Index:
    """The pass over a file's first rows, which begins behind its leading comments."""
    start, kinds = 0, []
    for k in sorted(parts):
        kinds += [x for x in parts[k]["kinds"] if x not in kinds]
        if parts[k]["byte"] is not None:
            start = parts[k]["byte"]
            break
    return scan(path, monotonic, checkpoint, start=start, rows=checkpoint, kinds=tuple(kinds))


def section_effect(path: str, start: int, end: int) -> dict:
    """What the lines that start within a range of bytes do to the section clock: metadata before
    the first header's end, how many headers end, the first dated section that begins and
    ends its header here, the start of the last one, and metadata after it."""
    before, pending, markers, anchor, last = {}, {}, 0, None, None
    keys = {k.encode() for k in METADATA_KEYS}
    with open(path, "rb") as f:
        for at, raw in _raw_lines(f, line_start(path, start)):
            if at >= end:
                break
            if raw.startswith(HEADER_END.encode()):
                if markers:
                    last = section_start(pending)
                    anchor = anchor if anchor is not None or not last else last[0]
                else:
                    before = pending
                pending, markers = {}, markers + 1
            elif not raw.startswith((b"***", b"#")) and raw.split(b"\t", 1)[0].strip() in keys:
                note_metadata(pending, raw.decode("utf-8", "replace").rstrip("\n").removesuffix("\r"))
    return {"before": before if markers else pending, "markers": markers, "anchor": anchor, "last": last, "after": pending if markers else {}}


def _raw_lines(f, start: int):
    f.seek(start)
    at = start
    for raw in f:
        yield at, raw
        at += len(raw)


def after_range(state: dict, effect: dict) -> dict:
    """The section clock behind a range, from the one before it and the range's effect."""
    clock, pending = Clock(anchor=state["anchor"], shift=state["shift"]), state["pending"] | effect["before"]
    if not effect["markers"]:
        return state | {"pending": pending}
    begin_section(clock, section_start(pending))
    if effect["markers"] > 1:
        clock.anchor = effect["anchor"] if clock.anchor is None else clock.anchor
        begin_section(clock, effect["last"] and tuple(effect["last"]))
    return {"anchor": clock.anchor, "shift": clock.shift, "pending": effect["after"]}


def scan_range(path: str, start: int, end: int, state: dict, checkpoint: int) -> tuple[Index, list, list]:
    """Facts of the lines that start within a range of bytes: an index, the range's runs of
    increasing times (first, last, smallest step, last step, number of the first row), before they
    are made monotonic, and for each of the index's places the last step within its run."""
    runs, steps = Runs(), []

    def on_row(raw, t, values):
        runs.note(t)
        if runs.rows % checkpoint == 0:
            steps.append(runs[-1][3])
        return len(runs) > RUNS

    begin, until = line_start(path, start), end
    clock = Clock(anchor=state["anchor"], shift=state["shift"], monotonic=False)
    try:
        index = scan(path, False, checkpoint, on_row, begin, clock, labelled=True, until=until, pending=state["pending"])
    except RecordingError:  # a record that begins before the range
        index = Index(broken=True)
    index.broken = index.broken or len(runs) > RUNS
    return index, runs, steps


def follow(index: Index, parts: list[tuple[Index, list, list]], monotonic: bool) -> Index | None:
    """The index of a file from that of its first rows and its other ranges in order, or None if
    only a pass from end to end can tell (quotes in a CSV's body, times that hardly increase)."""
    clock = index.clock
    for part, runs, steps in parts:
        if part.broken or part.frequency_axis:
            return None
        index.kinds += [k for k in part.kinds if k not in index.kinds]
        index.data_sections += part.data_sections - (part.leading_rows and index.section_open)
        if part.header_markers or part.data_rows:
            index.section_open = part.section_open
        places = list(zip(part.places, steps))
        for k, run in enumerate(runs):
            first, last, least, step, row = run
            end = runs[k + 1][4] if k + 1 < len(runs) else part.data_rows + 1
            if monotonic and not clock.begin_run(first, last, least):
                return None
            while places and places[0][0][1] < end:
                (byte, at_row, t, at, markers), at_step = places.pop(0)
                now = replace(at)
                if monotonic:
                    inner = at_row > row
                    now = replace(clock, anchor=at.anchor, shift=at.shift, source=t, placed=t + clock.offset if inner else clock.placed, step=at_step if inner else clock.step)
                index.places.append((byte, index.data_rows + at_row, now.placed if monotonic else t, now, index.header_markers + markers))
            if monotonic and end - row > 1:
                clock.end_run(last, step)
        if part.data_rows:
            index.bounds = (index.bounds[0], clock.placed if monotonic else part.bounds[1])
        clock.anchor, clock.shift = part.clock.anchor, part.clock.shift
        index.header_markers += part.header_markers
        index.data_rows += part.data_rows
        while index.max_columns < part.max_columns:
            index.max_columns += 1
            index.valid.append(False)
            index.repeats_time.append(True)
        for c in range(part.max_columns):
            index.valid[c] = index.valid[c] or part.valid[c]
            index.repeats_time[c] = index.repeats_time[c] and part.repeats_time[c]
        index.pending = part.pending
    index.clock, index.end = clock, index.stamp[0]
    return index


def _by_range(spark, ranges: list[tuple], work) -> dict[str, dict]:
    """work(row) of each range, a JSON value of bounded size, as {path: {k: value}}."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = [json.dumps(work(r)) for r in rows]
            yield pa.RecordBatch.from_pydict({"path": pa.array([r["path"] for r in rows], pa.string()), "k": pa.array([r["k"] for r in rows], pa.int32()), "facts": pa.array(out, pa.string())})

    found: dict[str, dict] = {}
    if ranges:
        table = spark.createDataFrame(ranges, "path string, k int, start long, end long, state string").repartition(len(ranges))
        for r in table.mapInArrow(run, "path string, k int, facts string").collect():  # a row for each RANGE bytes
            found.setdefault(r["path"], {})[r["k"]] = json.loads(r["facts"])
    return found


def make_indexes(spark, paths: list[str], folder: str, monotonic: bool, checkpoint: int, width: int = RANGE) -> list[str]:
    """Stores the indexes that are missing, and gives the paths that had to be read from end to end.

    A first job over ranges of bytes finds where the leading comments end.  One looks for section headers only;
    what they do to the clock is composed range by range, so that the next job knows the clock at the start of each range
    and finds the rows' facts; the recurrence of the times is composed from their runs."""
    import pyarrow as pa

    paths = [p for p in dict.fromkeys(paths) if load_index(folder, p, monotonic, checkpoint) is None]
    sizes = {p: size for p in paths if (size := os.path.getsize(p)) > width}
    starts = _by_range(spark, [(p, k, a, min(a + width, size), "") for p, size in sizes.items() for k, a in enumerate(range(0, size, width))], lambda r: body_start(r["path"], r["start"], r["end"]))
    heads = {p: first_rows(p, parts, monotonic, checkpoint) for p, parts in starts.items()}
    done = {p for p, head in heads.items() if head.end == head.stamp[0]}
    for p in done:
        # All rows are among the first ones.
        store_index(folder, p, heads[p], monotonic, checkpoint)
    heads = {p: head for p, head in heads.items() if head.data_rows == checkpoint and not head.frequency_axis and p not in done}
    cuts = {p: [h.end, *range((h.end // width + 1) * width, h.stamp[0], width), h.stamp[0]] for p, h in heads.items()}
    ranges = {p: list(enumerate(zip(c, c[1:]))) for p, c in cuts.items()}
    effects = _by_range(spark, [(p, k, a, b, "") for p, parts in ranges.items() if not is_csv(p) for k, (a, b) in parts], lambda r: section_effect(r["path"], r["start"], r["end"]))
    known = []
    for p, parts in ranges.items():
        state = {"anchor": heads[p].clock.anchor, "shift": heads[p].clock.shift, "pending": heads[p].pending}
        for k, (a, b) in parts:
            known.append((p, k, a, b, json.dumps(state)))
            state = after_range(state, effects[p][k]) if p in effects else state

    def facts(r):
        index, runs, steps = scan_range(r["path"], r["start"], r["end"], json.loads(r["state"]), checkpoint)
        return [to_json(index), runs, steps]

    for p, parts in _by_range(spark, known, facts).items():
        parts = [(from_json(parts[k][0]), *parts[k][1:]) for k in sorted(parts)]
        if (index := follow(heads[p], parts, monotonic)) is not None and stamp(p) == index.stamp:
            store_index(folder, p, index, monotonic, checkpoint)
            done.add(p)
    rest = [p for p in paths if p not in done]

    def whole(batches):
        for batch in batches:
            for p in batch.column("path").to_pylist():
                store_index(folder, p, scan(p, monotonic, checkpoint), monotonic, checkpoint)
            yield batch

    if rest:
        spark.createDataFrame([(p,) for p in rest], "path string").repartition(len(rest)).mapInArrow(whole, "path string").count()
    return rest


@dataclass
class Stretch(InputPartition):
    path: str
    recording_id: str
    start: int
    first_row: int
    rows: int
    clock: Clock
    markers: int
    columns: list[tuple[int, str]]
    stamp: tuple[int, int] | None  # None: a file that grows
    lo: float
    hi: float
    samples: tuple[int, int]


@dataclass
class Bounds:
    """What rows a reader is asked for: an interval of time, one of samples, names of channels and
    recordings (None: all)."""

    lo: float = -math.inf
    hi: float = math.inf
    first: int = 0
    last: int = 1 << 62
    channels: set | None = None
    recordings: set | None = None

    def push(self, f) -> bool:
        """Takes a filter over; False if Spark has to apply it."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        value = getattr(f, "value", None)
        if isinstance(f, IsNotNull):
            return name in ("recording_id", "channel", "sample", "t")
        if name in ("channel", "recording_id") and isinstance(f, (EqualTo, In)):
            named = {value} if isinstance(f, EqualTo) else set(value)
            attribute = "channels" if name == "channel" else "recordings"
            held = getattr(self, attribute)
            setattr(self, attribute, named if held is None else held & named)
            return True
        if name not in ("t", "sample") or not isinstance(value, (int, float)) or value != value:
            return False
        least, most = isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)), isinstance(f, (EqualTo, LessThanOrEqual, LessThan))
        strict = isinstance(f, (GreaterThan, LessThan))
        if not least and not most:
            return False
        if name == "t":
            value = float(value)
            self.lo = max(self.lo, math.nextafter(value, math.inf) if strict else value) if least else self.lo
            self.hi = min(self.hi, math.nextafter(value, -math.inf) if strict else value) if most else self.hi
        elif isinstance(value, int):
            self.first = max(self.first, value + strict) if least else self.first
            self.last = min(self.last, value - strict) if most else self.last
        else:
            return False
        return True


def kept_columns(columns: list[tuple[int, str]], places: str | None, names: set | None) -> list[tuple[int, str]]:
    """The channels that were asked for by place (1-based, by commas) and by name."""
    if places:
        asked = [int(x) for x in places.split(",")]
        if any(not 1 <= p <= len(columns) for p in asked):
            raise RecordingError("InvalidChannels", f"channels are 1 to {len(columns)}")
        columns = [columns[p - 1] for p in asked]
    if not columns:
        raise RecordingError("InvalidChannels", "no data channels")
    return [c for c in columns if names is None or c[1] in names]


class Options:
    """The options of the data source."""

    def __init__(self, options):
        get = options.get
        self.paths = [p.removeprefix("file://") for p in get("path", "").split(",") if p]
        self.bounds = Bounds(float(get("start", "-inf")), float(get("end", "inf")))
        if not self.paths or not self.bounds.lo <= self.bounds.hi:
            raise RecordingError("InvalidOptions", "a path and bounds in order are needed")
        self.monotonic = get("monotonic", "true").lower() == "true"
        self.checkpoint, self.index, self.channels = int(get("checkpoint", CHECKPOINT)), get("index"), get("channels")
        self.keep_duplicate_time = get("keep_duplicate_time", "false").lower() == "true"
        self.max_bytes = int(get("max_bytes", 1 << 28))


def stretches(o: Options, path: str, name: str, places: list, end_row: int, end_t: float, columns: list, mark) -> list[Stretch]:
    """The parts of a file between its places that may hold rows within the bounds; neighbours of a
    file of many places are one part, so that tasks don't multiply with places."""
    out, b, most = [], o.bounds, min(CHECKPOINT, -(-end_row // PARTS))
    columns = kept_columns(columns, o.channels, b.channels)
    if not columns or b.recordings is not None and name not in b.recordings or b.lo > b.hi:
        return out
    for k, (byte, row, before, clock, markers) in enumerate(places):
        upto = places[k + 1][1] if k + 1 < len(places) else end_row
        after = places[k + 1][2] if k + 1 < len(places) else end_t
        # Times increase, so a stretch that ends before the window or starts after it is skipped.
        outside = o.monotonic and (after < b.lo or before >= b.hi) or upto <= b.first or row > b.last
        if upto <= row or outside:
            continue
        if out and out[-1].first_row + out[-1].rows == row and out[-1].rows + upto - row <= most:
            out[-1].rows += upto - row
        else:
            out.append(Stretch(path, name, byte, row, upto - row, clock, markers, columns, mark, b.lo, b.hi, (b.first, b.last)))
    return out


def read_stretch(part: Stretch):
    """Long rows of a stretch, channel by channel; only the cells of its channels are parsed."""
    import pyarrow as pa

    if part.stamp is not None and stamp(part.path) != part.stamp:
        raise RecordingError("SourceChanged", part.path)
    samples, times, raws = [], [], []
    columns, sample = [[] for _ in part.columns], part.first_row

    def on_row(raw, t, values):
        nonlocal sample
        if part.lo <= t <= part.hi and part.samples[0] <= sample <= part.samples[1]:
            samples.append(sample)
            times.append(t)
            raws.append(raw)
            for out, (c, _) in zip(columns, part.columns):
                out.append(values[c] if c < len(values) else None)
        sample += 1
        return t > part.hi and part.clock.monotonic or sample > part.samples[1]

    got = scan(part.path, part.clock.monotonic, on_row=on_row, start=part.start, clock=replace(part.clock), markers=part.markers, labelled=part.start > 0, rows=part.rows, notes=False, wanted=[c for c, _ in part.columns], whole_records=part.stamp is None)
    if stamp(part.path) != part.stamp if part.stamp is not None else not samples and got.data_rows == 0:
        raise RecordingError("SourceChanged", part.path)
    n = len(samples)
    axis = [pa.array(samples, pa.int64()), pa.array(times, pa.float64()), pa.array(raws, pa.float64())]
    for (_, name), values in zip(part.columns, columns):
        names = [pa.repeat(pa.scalar(x, pa.string()), n) for x in (part.recording_id, name)]
        yield pa.RecordBatch.from_arrays([*names, *axis, pa.array(values, pa.float64())], names=["recording_id", "channel", "sample", "t", "raw_t", "value"])


class RecordingReader(DataSourceReader):
    def __init__(self, options):
        self.options = Options(options)

    def partitions(self):
        out, o = [], self.options
        for path, name in recording_ids(o.paths).items():
            index = load_index(o.index, path, o.monotonic, o.checkpoint) if o.index else None
            index = index or scan(path, o.monotonic, o.checkpoint)
            if not index.data_rows:
                raise RecordingError("TooShort", f"no numeric data in {path}")
            places = [(0, 0, -math.inf, Clock(monotonic=o.monotonic), 0), *index.places]
            out += stretches(o, path, name, places, index.data_rows, index.bounds[1], index.channels(o.keep_duplicate_time), index.stamp)
        return out

    def read(self, part: Stretch | None):
        yield from read_stretch(part) if part else ()


class FilteringReader(RecordingReader):
    """Takes filters over.  Spark keeps one read plan for each relation that was loaded, whatever plans
    use it; so this reader is for relations of one condition (``read_where``)."""

    def pushFilters(self, filters):
        for f in filters:
            if not self.options.bounds.push(f):
                yield f


class RecordingSource(DataSource):
    @classmethod
    def name(cls):
        return "recording"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (FilteringReader if self.options.get("pushdown") == "true" else RecordingReader)(self.options)

    def streamReader(self, schema):
        from wavemill.streaming.recording_stream import RecordingStreamReader

        return RecordingStreamReader(self.options)


def register(spark) -> None:
    """Makes the format known, and lets Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)


def index_folder(spark) -> str | None:
    """The folder of stored indexes, if the shared folder is one that files can be opened in."""
    shared = shared_dir(spark)
    return f"{shared.removeprefix('file://')}/wavemill-index" if shared.startswith(("file:/", "/")) else None


def indexed(spark, path: str, monotonic: bool = True, checkpoint: int = CHECKPOINT) -> Index:
    """The index of a file, made now if it isn't stored."""
    folder = index_folder(spark)
    if folder is None:
        return scan(path, monotonic, checkpoint)
    make_indexes(spark, [path], folder, monotonic, checkpoint)
    return load_index(folder, path, monotonic, checkpoint)


def open_interval(spark, path: str, start: float, end: float, **options):
    """The rows of a file within [start, end]; two samples at least must lie there.  The file's
    index stays that of the whole file."""
    long = read_recording(spark, path, start=start, end=end, **options)
    if long.select("sample").distinct().limit(2).count() < 2:
        raise RecordingError("TooShort", "fewer than two rows in the interval")
    return long


def read_recording(spark, *paths: str, **options):
    """Long rows of one or more files; options as for the data source."""
    register(spark)
    if "index" not in options and (folder := index_folder(spark)):
        plain = [p.removeprefix("file://") for p in paths]
        make_indexes(spark, plain, folder, str(options.get("monotonic", True)).lower() == "true", int(options.get("checkpoint", CHECKPOINT)))
        options["index"] = folder
    reader = spark.read.format("recording").option("path", ",".join(paths))
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load()


def read_where(spark, condition, *paths: str, **options):
    """Long rows that meet a condition (text or Column), of which the source takes over comparisons of t, sample,
    channel and recording_id with constants.

    Each call loads a relation of its own, and nothing that is done with the result is pushed below
    the condition, so the source sees the same filters in every plan."""
    rows = read_recording(spark, *paths, pushdown=True, **options).where(condition)
    return rows.observe(f"rows_{uuid.uuid4().hex}", F.count("*").alias("n"))
