"""Secrets in texts: pattern candidates with structural confirmation.

Three base patterns report as they match.  Further candidates (base64 and hex runs, armoured keys, dotted tokens)
are reported only when what they encode has the structure of a secret: a DER sequence whose nested lengths fit and
that starts like a private key, plain or encrypted, a length-prefixed key blob, or a token header that is JSON with an
algorithm.  Every candidate is decoded; parsers decide, not prefixes.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "armour", "der", "blob", "token")
# fixed values: the base patterns
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = ("passw", "secret", "token", "api")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----\s*((?:[A-Za-z][A-Za-z0-9-]*:[^\n]*\n)*)([A-Za-z0-9+/=\s]{16,}?)-----END \1-----")
_CIPHER = re.compile(r"DEK-Info:[ \t]*[A-Z0-9-]+,[ \t]*((?:[0-9A-Fa-f]{2})+)[ \t]*\r?$", re.M)
#: Matches nothing itself, so that candidates may overlap: what isn't a header can hide no token behind it.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+))")
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
_HEXES = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){20,}(?![0-9A-Fa-f])")


def unbase64(s: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not."""
    s = re.sub(r"\s", "", s).rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(b: bytes, begin: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag and content range of the DER items that fill b[begin:end] exactly; None where lengths don't fit."""
    out = []
    while begin < end:
        if begin + 2 > end:
            return None
        tag, n, at = b[begin], b[begin + 1], begin + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n, at = int.from_bytes(b[at : at + k], "big"), at + k
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        begin = at + n
    return out


def is_private_der(b: bytes | None) -> bool:
    """PKCS#1, PKCS#8 or SEC1: a sequence starting with a small version number, then integers, an algorithm or a key."""
    if not b or len(b) < 20 or b[0] != 0x30:
        return False
    outer = der_items(b, 0, len(b))
    if not outer or len(outer) != 1:
        return False
    items = der_items(b, outer[0][1], outer[0][2])
    if not items or len(items) < 2 or items[0][0] != 2 or items[0][2] - items[0][1] != 1 or b[items[0][1]] > 3:
        return False
    tags = [t for t, _, _ in items]
    if tags[1] == 2:
        return len(tags) >= 5 and all(t == 2 for t in tags[:5])
    if tags[1] == 0x30:
        return _is_algorithm(b, items[1]) and len(tags) > 2 and tags[2] == 4
    return tags[1] == 4


def _is_algorithm(b: bytes, item: tuple[int, int, int]) -> bool:
    inner = der_items(b, item[1], item[2])
    return bool(inner) and inner[0][0] == 6 and inner[0][2] - inner[0][1] >= 3


def is_encrypted_der(b: bytes | None) -> bool:
    """Encrypted PKCS#8: a sequence of an algorithm with parameters and a string of at least one cipher block."""
    if not b or len(b) < 20 or b[0] != 0x30:
        return False
    outer = der_items(b, 0, len(b))
    items = der_items(b, outer[0][1], outer[0][2]) if outer and len(outer) == 1 else None
    if not items or [t for t, _, _ in items] != [0x30, 4] or not _is_algorithm(b, items[0]):
        return False
    parts, n = der_items(b, items[0][1], items[0][2]), items[1][2] - items[1][1]
    return len(parts) == 2 and parts[1][0] == 0x30 and bool(der_items(b, parts[1][1], parts[1][2])) and n >= 8 and n % 8 == 0


def is_encrypted_body(head: str, b: bytes | None) -> bool:
    """An armoured key with encryption headers: a cipher's start value, and whole blocks of that size."""
    m = _CIPHER.search(head)
    block = len(m[1]) // 2 if m and "Proc-Type:" in head and "ENCRYPTED" in head else 0
    return block in (8, 16) and bool(b) and len(b) % block == 0


def is_key(b: bytes | None) -> bool:
    return is_private_der(b) or is_encrypted_der(b)


def is_key_blob(b: bytes | None) -> bool:
    """A stored private key with its magic, whose first length-prefixed names fit."""
    magic = b"openssh-key-v1\0"
    if not b or not b.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        if at + 4 > len(b):
            return False
        at += 4 + int.from_bytes(b[at : at + 4], "big")
        if at > len(b):
            return False
    return True


def is_signed_token(s: str) -> bool:
    head = unbase64(s.split(".", 1)[0])
    try:
        x = json.loads(head) if head else None
    except (ValueError, RecursionError):  # not JSON, or nested beyond what a header could be
        return False
    return isinstance(x, dict) and isinstance(x.get("alg"), str)


def find(text: str) -> list[tuple[str, int, int]]:
    """All reported spans (kind, start, end) in code points, by start, then kind."""
    out = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        for m in _ARMOUR.finditer(text):
            b = unbase64(m[3])
            if is_key(b) or is_key_blob(b) or is_encrypted_body(m[2], b):
                out.append(("armour", m.start(), m.end()))
    end = 0
    for m in _TOKEN.finditer(text):
        if m.start() >= end and is_signed_token(m[1]):
            end = m.end(1)
            out.append(("token", m.start(), end))
    for m in _B64.finditer(text):
        b = unbase64(m[0])
        if is_key(b):
            out.append(("der", m.start(), m.end()))
        elif is_key_blob(b):
            out.append(("blob", m.start(), m.end()))
    for m in _HEXES.finditer(text):
        b = bytes.fromhex(m[0])
        if is_key(b):
            out.append(("der", m.start(), m.end()))
        elif is_key_blob(b):
            out.append(("blob", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches):
    for batch in batches:
        cols = [[] for _ in range(5)]
        for t in batch.column(1).to_pylist():
            spans = find(t) if t else []
            base = [s for s in spans if s[0] in KINDS[:3]]
            for col, v in zip(cols, (*(sum(s[0] == k for s in base) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans))):
                col.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_assign, n_access, n_hex, base_sha256 (of the base spans), spans.

    Null text counts as empty.  Rows are independent, ids may be null or repeat, and other columns of docs are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("doc_id", id_col)
