"""Single text files written by executors: ``df.write.format("recording_text")``.

Each task writes the lines of its partition to a part of its own, in a folder beside the target that the
driver and all executors see.  The commit puts the head and the parts of the tasks that count, in the order
of partitions, into one file beside the target and renames it; until then, and if a task or
the commit fails, the target stays as it is.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from wavemill.recording import RecordingError
from wavemill.sources.numeric import csv_field, number, tab_field


@dataclass(frozen=True)
class Layout:
    """How a row becomes a line."""

    delimiter: str = ","
    newline: str = "\n"
    digits: int = 17
    pairs: bool = False  # the first column is repeated before each of the others, and a comment column ends the line
    raw: bool = False  # the only column is the text itself, breaks included

    def cell(self, v) -> str:
        if isinstance(v, str):
            return csv_field(v) if self.delimiter == "," else tab_field(v)
        return str(v) if isinstance(v, int) else number(v, self.digits)

    def line(self, row: Sequence) -> str:
        if self.raw:
            return row[0] or ""
        cells = [self.cell(v) for v in row]
        if self.pairs:
            cells = [x for v in cells[1:] for x in (cells[0], v)] + [""]
        return self.delimiter.join(cells) + self.newline


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str


class TextWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.target, self.parts, self.head = options["target"], options["parts"], options.get("head", "")
        self.layout = Layout(**json.loads(options.get("layout", "{}")))

    def write(self, iterator):
        task = TaskContext.get()
        path = f"{self.parts}/{task.partitionId():08d}-{task.taskAttemptId()}"
        with open(path, "w", encoding="utf-8", newline="") as f:
            for batch in iterator:
                f.writelines(map(self.layout.line, zip(*(c.to_pylist() for c in batch.columns))))
        return Part(task.partitionId(), path)

    def commit(self, messages):
        handle, temporary = tempfile.mkstemp(dir=os.path.dirname(self.target))
        try:
            with os.fdopen(handle, "wb") as out:
                out.write(self.head.encode())
                for part in sorted((m for m in messages if m), key=lambda m: m.partition):
                    with open(part.path, "rb") as f:
                        shutil.copyfileobj(f, out, 1 << 20)
            os.replace(temporary, self.target)
        except BaseException:
            os.unlink(temporary)
            raise
        finally:
            shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.parts, ignore_errors=True)


class TextTarget(DataSource):
    @classmethod
    def name(cls):
        return "recording_text"

    def writer(self, schema, overwrite):
        return TextWriter(self.options)


def write_ordered(rows: DataFrame, path: str, head: str = "", layout: Layout = Layout(), source: str | None = None) -> None:
    """The head, and a line for each row in the order of the DataFrame's partitions (sort it first); the
    source itself can't be the target."""
    path = os.path.abspath(path.removeprefix("file://"))
    if source and os.path.realpath(source) == os.path.realpath(path):
        raise RecordingError("InvalidOptions", "a recording can't be exported over itself")
    parts = f"{os.path.dirname(path)}/.{os.path.basename(path)}-{uuid.uuid4().hex}"
    os.makedirs(parts)
    rows.sparkSession.dataSource.register(TextTarget)
    try:
        rows.write.format("recording_text").options(target=path, parts=parts, head=head, layout=json.dumps(asdict(layout))).mode("append").save()
    finally:
        shutil.rmtree(parts, ignore_errors=True)
