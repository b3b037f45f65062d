"""Secret scans by structural confirmation.

Three plain patterns give the base spans.  Beyond them, runs of base64 or hex
characters are decoded and reported only if their structure confirms a secret:

* ``jwt``: three base64url parts, the first of which decodes to a JSON object with an
  ``alg`` member, the second to a JSON object, the third to a signature;
* ``der``: a key in DER: a SEQUENCE whose nested lengths add up exactly and whose
  first member is a version INTEGER or an algorithm SEQUENCE;
* ``openssh``: the length-prefixed fields of an OpenSSH private key;
* ``sshpub``: a length-prefixed SSH algorithm name followed by fields that fill the blob.

Line breaks inside a base64 body (as in armoured keys) are skipped before decoding.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import slices

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
# A text without any of these in lower case has no assignment.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
HEX = re.compile(r"[0-9a-f]{16,}", re.ASCII)
JWT = re.compile(r"[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{16,}", re.ASCII)
# A wrapped body has lines of 60 characters or more and a last one of any length.
B64 = re.compile(r"(?:[A-Za-z0-9+/_-]{60,}\r?\n)+[A-Za-z0-9+/_-]+={0,2}|[A-Za-z0-9+/_-]{40,}={0,2}", re.ASCII)
OPENSSH = b"openssh-key-v1\0"
HEX_BODY = re.compile(r"(?:[0-9A-Fa-f]{2}){32,}", re.ASCII)

KINDS = ("assign", "access", "hex", "jwt", "der", "openssh", "sshpub")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_structural long"


def _b64(text: str) -> bytes | None:
    body = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (ValueError, binascii.Error):
        return None


def _json_object(part: str) -> dict | None:
    raw = _b64(part)
    if not raw or raw[:1] != b"{":
        return None
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _der(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the element at a place, or None if its length is wrong."""
    if at + 2 > len(data):
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4 or at + width > len(data):
            return None
        n, at = int.from_bytes(data[at : at + width], "big"), at + width
        if n < 128:
            return None
    return (tag, at, at + n) if at + n <= len(data) else None


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE filling the data whose members' lengths add up, two levels deep."""
    top = _der(data, 0)
    if not top or top[0] != 0x30 or top[2] != len(data) or len(data) < 24:
        return False
    at, tags = top[1], []
    while at < top[2]:
        member = _der(data, at)
        if not member or member[2] > top[2]:
            return False
        if member[0] == 0x30:
            inner = member[1]
            while inner < member[2]:
                x = _der(data, inner)
                if not x or x[2] > member[2]:
                    return False
                inner = x[2]
        tags.append(member[0])
        at = member[2]
    return len(tags) >= 2 and tags[0] in (0x02, 0x30) and all(t in (0x02, 0x03, 0x04, 0x05, 0x06, 0x30, 0xA0, 0xA1) for t in tags)


def _fields(data: bytes, at: int) -> int:
    """Number of length-prefixed fields that fill the data from a place on; 0 if they don't."""
    n = 0
    while at < len(data):
        if at + 4 > len(data):
            return 0
        at += 4 + struct.unpack_from(">I", data, at)[0]
        n += 1
    return n if at == len(data) else 0


def _field(data: bytes, at: int) -> tuple[bytes, int] | None:
    """A length-prefixed field at a place and the place after it."""
    if at + 4 > len(data):
        return None
    end = at + 4 + struct.unpack_from(">I", data, at)[0]
    return (data[at + 4 : end], end) if end <= len(data) else None


def is_openssh_key(data: bytes) -> bool:
    """The magic, then names of cipher and key derivation, its options, a count, as many public
    keys (each itself a field list that begins with an algorithm) and the private part, which
    fill the data."""
    at, names = len(OPENSSH), []
    for _ in range(3):
        if not (got := _field(data, at)):
            return False
        names.append(got[0])
        at = got[1]
    if not all(re.fullmatch(rb"[a-z0-9@.-]{1,64}", n) for n in names[:2]) or at + 4 > len(data):
        return False
    count, at = struct.unpack_from(">I", data, at)[0], at + 4
    if not 1 <= count <= len(data) // 4:
        return False
    for _ in range(count):
        got = _field(data, at)
        if not got or not is_public_key(got[0]):
            return False
        at = got[1]
    got = _field(data, at)
    return bool(got) and len(got[0]) >= 8 and got[1] == len(data)


def is_public_key(data: bytes) -> bool:
    """A field with the name of an algorithm, and others, which fill the data."""
    got = _field(data, 0)
    return bool(got) and bool(re.fullmatch(rb"(ssh-|ecdsa-|sk-)[a-z0-9@.-]{1,60}", got[0])) and _fields(data, 0) >= 2


def confirm(data: bytes) -> str | None:
    """The kind of key that the bytes encode, or None."""
    if data.startswith(OPENSSH):
        return "openssh" if is_openssh_key(data) else None
    if len(data) > 16 and is_public_key(data):
        return "sshpub"
    return "der" if is_der_key(data) else None


def structural_spans(text: str) -> list[tuple[int, int, str]]:
    # Every candidate below has 32 characters or more without white space.
    if max(map(len, text.split()), default=0) < 32:
        return []
    found = []
    for m in JWT.finditer(text):
        head, body, _ = m[0].split(".", 2)
        header = _json_object(head)
        if header is not None and isinstance(header.get("alg"), str) and _json_object(body) is not None:
            found.append((m.start(), m.end(), "jwt"))
    for m in B64.finditer(text):
        # The last line may be words that follow the body, such as an armour's END.
        for end in dict.fromkeys((m.end(), m.start() + max(m[0].rfind("\n"), 0))):
            data = _b64(text[m.start() : end])
            if data and (kind := confirm(data)):
                found.append((m.start(), end - (text[end - 1] == "\r"), kind))
                break
    for m in HEX_BODY.finditer(text):
        if kind := confirm(bytes.fromhex(m[0])):
            found.append((m.start(), m.end(), kind))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    low, found = text.lower(), []
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then by kind as listed in KINDS, then by end."""
    spans = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan(batches):
    for batch in slices(batches):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_structural")}
        for text in batch.column(1).to_pylist():
            base = base_spans(text or "")
            more = structural_spans(text or "")
            for kind in ("assign", "access", "hex"):
                out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(base + more))
            out["n_structural"].append(len(more))
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out.values())], names=["doc_id", *out])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the secrets of its whole text.

    Null or empty text: no spans, digest of the empty string.  Null ids and repeated rows
    pass through, a row each; other columns are not read.  An empty table gives no rows.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scan, SCHEMA)


def _drop_lines(batches, at: int):
    """Replaces each span by a mark of its kind."""
    for batch in slices(batches):
        texts = []
        for text in batch.column(at).to_pylist():
            spans = sorted(base_spans(text) + structural_spans(text)) if text else []
            if not spans:
                texts.append(text)
                continue
            parts, end = [], 0
            for a, b, kind in spans:
                if a >= end:
                    parts += [text[end:a], f"<{kind}>"]
                end = max(end, b)
            texts.append("".join([*parts, text[end:]]))
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns; in the text column each secret gives way to its kind in
    angle brackets (overlapping secrets to the first one's).  Null text stays null."""
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda batches: _drop_lines(batches, at), docs.schema)


COUNTS_SQL = r"""
SELECT doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: len(x) >= 12)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 18)) AS n_access,
  len(regexp_extract_all(coalesce(text, ''), '[0-9a-f]{16,}')) AS n_hex
FROM documents
"""
