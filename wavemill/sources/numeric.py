"""Cells, labels and records of signal files."""

from __future__ import annotations

import math
import re

# Metadata keys of LabVIEW measurement files, and labels of axes.
METADATA_KEYS = frozenset({
    "LabVIEW Measurement", "Writer_Version", "Reader_Version", "Separator", "Decimal_Separator", "Multi_Headings", "X_Columns", "Time_Pref",
    "Operator", "Date", "Time", "Channels", "Samples", "Y_Unit_Label", "X_Dimension", "X0", "Delta_X",
})
AXIS_LABELS = frozenset({"Time", "X_Value", "X", "Comment"})
HEX = re.compile(r"[+-]?0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)([pP][+-]?[0-9]+)?")
DECIMAL = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
BLANKS = " \t\r\n\f\v"
WORD = re.compile(r"[+-]?(nan(\([A-Za-z0-9_]*\))?|inf(inity)?)", re.IGNORECASE)


def parse_cell(text: str) -> tuple[float | None, bool]:
    """(value, is a number): the whole cell must be one.  NaN, infinities and numbers out of
    range are numbers without a value."""
    if DECIMAL.fullmatch(text):
        value = float(text)
    elif HEX.fullmatch(text):
        try:
            value = float.fromhex(text)
        except OverflowError:
            value = math.inf
    else:
        return None, WORD.fullmatch(text) is not None
    return (value if math.isfinite(value) else None), True


def parse_decimal(text: str) -> float | None:
    """User input: decimal comma allowed, the whole text a finite number."""
    return parse_cell(text.strip().replace(",", "."))[0]


def channel_label(raw: str, position: int) -> tuple[str, bool]:
    """(name, generated): units in brackets or parentheses are cut off; axis names and empty
    labels give way to Channel_<position>."""
    label = raw.strip(" \t\r\n\f\v")
    for mark in "[(":
        head = label.split(mark, 1)[0].strip(" \t\r\n\f\v")
        if head:
            label = head
    if not label or label in AXIS_LABELS:
        return f"Channel_{position}", True
    return label, False


def split_tabs(line: str) -> list[str]:
    return [c.strip(" \t\r\n\f\v") for c in line.replace(",", ".").split("\t")]


def split_csv(record: str) -> list[str] | None:
    """Fields of a record, or None if a quoted field goes on in the next line."""
    fields, at, n = [], 0, len(record)
    while True:
        if at < n and record[at] == '"':
            parts, at = [], at + 1
            while True:
                end = record.find('"', at)
                if end < 0:
                    return None
                parts.append(record[at:end])
                at = end + 1
                if at < n and record[at] == '"':
                    parts.append('"')
                    at += 1
                    continue
                break
            while at < n and record[at] in BLANKS:
                at += 1
            if at < n and record[at] != ",":
                raise ValueError("malformed CSV record: text after a closing quote")
            fields.append("".join(parts).strip(" \t\r\n\f\v"))
        else:
            end = record.find(",", at)
            end = n if end < 0 else end
            if '"' in record[at:end]:
                raise ValueError("malformed CSV record: a quote within a field")
            fields.append(record[at:end].strip(" \t\r\n\f\v"))
            at = end
        if at >= n:
            return fields
        at += 1


def number(v: float | None, digits: int = 17) -> str:
    """Shortest fixed-precision text of a number; nothing for a missing one."""
    return "" if v is None or v != v else f"{v:.{digits}g}"


def csv_field(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') else text


def tab_field(text: str) -> str:
    return re.sub(r"[\t\r\n]", " ", text)
