"""Sinks: tables as CSV, tab-separated text and LabVIEW measurement files, with metadata.

``write_text`` lets every executor write its part of a directory; the others make one ordered
file, for recordings that people open elsewhere, from parts that executors write (see
text_writer.py); a failure leaves the old file as it was.
"""

from __future__ import annotations

import datetime
import hashlib
import os
import re
import urllib.parse
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.recording import long_to_wide
from wavemill.sources.numeric import number, tab_field
from wavemill.sources.text_writer import Layout, write_ordered


def percent_text(text: str) -> str:
    """Text of any characters as one line of plain ones."""
    return urllib.parse.quote(text, safe=" ").replace("~", "%7E")


def unpercent_text(text: str) -> str:
    return urllib.parse.unquote(text)


def metadata_lines(sections: Mapping[str, Mapping[str, object]]) -> list[str]:
    """``# [section]`` and ``# key=value`` lines."""
    out = []
    for name, pairs in sections.items():
        out.append(f"# [{name}]")
        out += [f"# {k}={percent_text(v) if isinstance(v, str) else number(v) if isinstance(v, float) else v}" for k, v in pairs.items()]
    return out


def read_metadata(comments: Iterable[str]) -> dict[str, dict[str, str]]:
    """Sections of key=value comments; keys before any section belong to ''."""
    out: dict[str, dict[str, str]] = {}
    section = ""
    for line in comments:
        line = line.removeprefix("#").strip()
        if m := re.fullmatch(r"\[(\w+)\]", line):
            section = m[1]
            out.setdefault(section, {})
        elif "=" in line:
            key, value = line.split("=", 1)
            out.setdefault(section, {})[key.strip()] = unpercent_text(value)
    return out


def make_folder(path: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)


def table_rows(wide: DataFrame, channels: Sequence[str], axis: str = "t", order: str | None = None) -> DataFrame:
    """(axis, channels) in the order of the axis (or of ``order``), one partition after another."""
    return wide.orderBy(order or axis).select(axis, *(F.col(f"`{c}`") for c in channels))


def write_text(long: DataFrame, path: str, channels: Sequence[str], delimiter: str = ",") -> None:
    """A directory of parts with headers, each written where its rows are."""
    wide = table_rows(long_to_wide(long, channels), channels).withColumnRenamed("t", "Time")
    wide.write.mode("overwrite").option("header", True).option("sep", delimiter).option("nullValue", "").option("emptyValue", "").csv(path)


def _line(fields: Sequence[str], layout: Layout) -> str:
    return layout.delimiter.join(map(layout.cell, fields)) + layout.newline


def _layout(path: str, digits: int = 17) -> Layout:
    return Layout(",", "\n", digits) if path.lower().endswith(".csv") else Layout("\t", "\r\n", digits)


def write_file(long: DataFrame, path: str, channels: Sequence[str], metadata: Mapping | None = None, digits: int = 17, source: str | None = None, order: str = "t") -> None:
    """One CSV file (name in .csv) or tab-separated file: Time and the channels."""
    layout = _layout(path, digits)
    head = "".join(line + layout.newline for line in metadata_lines(metadata or {})) + _line(["Time", *channels], layout)
    write_ordered(table_rows(long_to_wide(long, channels), channels, "t", order), path, head, layout, source)


def spectrum_wide(spectrum: DataFrame, channels: Sequence[str]) -> DataFrame:
    return spectrum.groupBy("bin").agg(F.min("freq").alias("freq"), *(F.max(F.when(F.col("channel") == c, F.col("amp"))).alias(c) for c in channels))


def write_spectrum_file(spectrum: DataFrame, path: str, channels: Sequence[str], sampling: Mapping[str, object] | None = None) -> None:
    """Frequency and the amplitudes of the channels; ``sampling`` goes to [fft_sampling]."""
    layout = _layout(path)
    sections = {"export": {"plot_mode": "frequency"}} | ({"fft_sampling": sampling} if sampling else {})
    head = "".join(line + layout.newline for line in metadata_lines(sections)) + _line(["Frequency", *channels], layout)
    write_ordered(table_rows(spectrum_wide(spectrum, channels), channels, "freq"), path, head, layout)


FRF_COLUMNS = ("frequency_hz", "dynamic_coefficient", "h_real", "h_imag", "valid", "coherence", "coherence_valid", "reference_amplitude", "reference_valid")


def write_frf_file(rows: DataFrame, path: str, several: bool = False) -> None:
    """Rows as of ``frf.frf_rows``; several responses add their number and name."""
    columns = [*FRF_COLUMNS, *(["response_index", "response_name"] if several else [])]
    write_ordered(rows.orderBy("response_index", "frequency_hz").select(*columns), path, "# data_kind=frf\n" + ",".join(columns) + "\n")


def lvm_head(channels: Sequence[str], when: datetime.datetime | None = None) -> str:
    """The two header blocks of a LabVIEW measurement file and its labels."""
    when = when or datetime.datetime(1970, 1, 1)
    date, clock = when.strftime("%Y/%m/%d"), when.strftime("%H:%M:%S.%f")
    n = len(channels)
    first = {"LabVIEW Measurement": "", "Writer_Version": "2", "Reader_Version": "2", "Separator": "Tab", "Decimal_Separator": ".", "Multi_Headings": "Yes", "X_Columns": "Multi", "Time_Pref": "Relative", "Date": date, "Time": clock}
    second = {"Channels": [str(n)]} | {key: [value, ""] * n for key, value in (("Date", date), ("Time", clock), ("X0", "0"), ("X_Dimension", "Time"))}
    lines = [
        *(f"{k}\t{v}".rstrip("\t") for k, v in first.items()), "***End_of_Header***", "",
        *("\t".join([k, *v]).rstrip("\t") for k, v in second.items()), "***End_of_Header***",
        "\t".join(x for c in channels for x in ("X_Value", tab_field(c))) + "\tComment",
    ]
    return "".join(line + "\r\n" for line in lines)


def write_lvm(long: DataFrame, path: str, channels: Sequence[str], when: datetime.datetime | None = None, metadata: Mapping | None = None) -> None:
    """A LabVIEW measurement file: two header blocks, then pairs of X_Value and channel, and a
    Comment column."""
    head = "".join(line + "\r\n" for line in metadata_lines(metadata or {})) + lvm_head(channels, when)
    write_ordered(table_rows(long_to_wide(long, channels), channels), path, head, Layout("\t", "\r\n", pairs=True))


def result_key(recipe: object) -> str:
    """The same text for the same recipe: names the folder of a stored result."""
    return hashlib.sha256(repr(recipe).encode()).hexdigest()[:32]


def source_stamp(spark, paths: Sequence[str]) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of each source, by whatever file system holds it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((str(status.getPath()), status.getLen(), status.getModificationTime()))
    return out


def store_result(df: DataFrame, folder: str, recipe: object, sources: Sequence[str] = ()) -> DataFrame:
    """The result of a recipe over source files, written once as Parquet and read back for as
    long as none of the sources changes."""
    spark = df.sparkSession
    path = f"{folder}/{result_key((recipe, source_stamp(spark, sources)))}"
    return spark.read.schema(df.schema).parquet(path) if _exists(spark, path) else _write(df, path)


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
