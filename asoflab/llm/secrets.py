"""Secret scans: patterns first, then structural confirmation.

Base kinds are found by pattern: ``assign`` (a named credential with a value of 8
characters or more), ``access`` (AKIA keys of 16 or more) and ``hex`` (lower-case
hex of 32 or more digits). Further kinds are reported only if a candidate's
decoded bytes have the structure of a key:

* ``jwt``: three dot-separated base64url parts whose first is a JSON object with "alg";
* ``der``: base64 (also inside PEM armour) or hex that is one ASN.1 SEQUENCE whose nested lengths fill it exactly,
  or PEM armour of whole cipher blocks whose header lines name the cipher;
* ``ssh``: base64 (also inside PEM armour) of length-prefixed fields that fill it exactly, the first naming a key
  type, or of an OpenSSH private key.

Base64 may be of either alphabet, wrapped, and have escaped line ends, as in JSON strings.

Positions are code points, ends exclusive. Null texts count as empty. Whole texts
are scanned, whatever their length; overlapping spans of different kinds all stay.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{3,40})-----((?:[^-]++|-(?!----))*+)-----END \1-----")
DEK = re.compile(r"DEK-Info:[ \t]*[A-Za-z0-9-]+,[ \t]*[0-9A-Fa-f]{16,}")
#: How base64 of a SEQUENCE (0x30), of a short length prefix or of "ope" can begin; more of it must follow on the line.
BASE64 = re.compile(r"(?:M[A-P]|AAAA|b3Bl)(?=[A-Za-z0-9+/_-]{20})")
BASE64_PLAIN = re.compile(r"[A-Za-z0-9+/]+")
BASE64_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
BASE64_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
LINE_END = re.compile(r"[ \t]*\r?\n[ \t]*|(?:\\+r)?\\+n|\\+r")
PADDING = re.compile(r"={0,2}")
DER_HEX = re.compile(r"(?<![0-9a-fA-F])30[0-9a-fA-F]{30,}")
SSH_TYPES = (b"ssh-", b"ecdsa-", b"sk-")
OPENSSH = b"openssh-key-v1\0"


def decoded(text: str) -> bytes | None:
    """Bytes of base64 (either alphabet, padding optional), or None."""
    text = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_der(data: bytes | None, depth: int = 0) -> bool:
    """Whether data is exactly one SEQUENCE whose members' lengths fill it, nested sequences too."""
    if not data or len(data) < 4 or data[0] != 0x30 or depth > 16:
        return False
    found = _element(data, 0)
    if not found or found[1] != len(data):
        return False
    at, end, members = found[0], found[1], 0
    while at < end:
        inner = _element(data, at)
        if not inner or inner[1] > end:
            return False
        if data[at] == 0x30 and inner[1] - at >= 4 and not is_der(data[at : inner[1]], depth + 1):
            return False
        at, members = inner[1], members + 1
    return members > 1 or depth > 0


def _element(data: bytes, at: int) -> tuple[int, int] | None:
    """Start and end of the content of the element at a position."""
    if at + 2 > len(data):
        return None
    n, at = data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > len(data):
            return None
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    return (at, at + n) if at + n <= len(data) else None


def is_ssh(data: bytes | None) -> bool:
    at, fields = 0, []
    while data and at < len(data):
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return len(fields) > 1 and fields[0].startswith(SSH_TYPES)


def openssh_end(data: bytes) -> tuple[int, bool]:
    """Where an OpenSSH private key ends (cipher, derivation, its options, public keys, private part),
    as far as data tells, and whether that is its end."""
    at, fields, wanted = len(OPENSSH), [], 3
    while len(fields) < wanted:
        n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if at + n > len(data):
            return at + n, False
        fields.append(data[at : at + n])
        at += n
        if len(fields) == 3:
            wanted, at = 4 + int.from_bytes(data[at : at + 4], "big"), at + 4
    return at, len(fields) > 4 and len(fields[-1]) > 0 and all(map(is_ssh, fields[3:-1]))


def is_openssh(data: bytes | None) -> bool:
    """Some ciphers leave a tag of 16 bytes after the private part."""
    if not data or not data.startswith(OPENSSH):
        return False
    end, whole = openssh_end(data)
    return whole and len(data) - end in (0, 16)


def sizes(data: bytes) -> tuple[int, float]:
    """The least and the most bytes that the structure which begins with data can have; (0, 0) if it begins none."""
    if data[:1] == b"\x30":
        size = data[1] & 0x7F if data[1] & 0x80 else 0
        if size > 4 or data[1] == 0x80:
            return 0, 0
        n = 2 + size + (int.from_bytes(data[2 : 2 + size], "big") if size else data[1])
        return n, n
    if data.startswith(OPENSSH):
        end, whole = openssh_end(data)
        return end, end + 16 if whole or end <= len(data) else math.inf
    if not data[4:].startswith(SSH_TYPES):
        return 0, 0
    at = 0
    while at + 4 <= len(data):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at, math.inf


def kind_of(data: bytes | None) -> int | None:
    """The place in KINDS of the structure that fills data."""
    if is_der(data):
        return 4
    return 5 if is_ssh(data) or is_openssh(data) else None


def kind_of_pem(label: str, body: str) -> int | None:
    """The kind of what stands in PEM armour; ciphertext, which has no structure, by its header lines."""
    rows = [r.strip() for r in LINE_END.split(body.strip().replace("\\/", "/"))]
    while rows and not rows[0]:
        rows = rows[1:]
    n = 0
    if rows and ":" in rows[0]:
        n = rows.index("") if "" in rows else next((k for k, r in enumerate(rows) if ":" not in r), len(rows))
    data = decoded("".join(rows[n:]))
    if label.endswith("PRIVATE KEY") and any(map(DEK.match, rows[:n])):
        return 4 if data and len(data) % 8 == 0 else None
    return kind_of(data)


def base64_span(text: str, start: int) -> tuple[int, int] | None:
    """End and kind of the structure that base64 from start on holds, on one line or wrapped.

    The structure ends where a line does; its own lengths tell how many lines are taken.
    """
    least, most = sizes(decoded(text[start : start + 20]))
    at, chars = start, ""
    while most and (line := BASE64_LINE.match(text, at)):
        if (least - len(chars) * 3 // 4) * 4 // 3 > len(text) - at:
            return None
        for part in dict.fromkeys((BASE64_PLAIN.match(line[0]), line)):
            if not part or (len(chars) + len(part[0])) * 3 // 4 < least:
                continue
            end, data = at + len(part[0]), decoded(chars + part[0])
            if text[end : end + 1] not in BASE64_CHARS and (kind := kind_of(data)) is not None:
                return PADDING.match(text, end).end(), kind
        chars += line[0]
        if len(chars) * 3 // 4 >= least:
            least, most = sizes(decoded(chars[: len(chars) // 4 * 4]))
            if len(chars) * 3 // 4 > most:
                return None
        more = LINE_END.match(text, line.end())
        if not more:
            return None
        at = more.end()
    return None


def is_jwt(text: str) -> bool:
    head, body, _ = text.split(".", 2)
    raw = decoded(head)
    try:
        return isinstance(told := json.loads(raw or b""), dict) and isinstance(told.get("alg"), str) and decoded(body) is not None
    except (ValueError, RecursionError):
        return False


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base kinds."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, by start, then kind."""
    text = text or ""
    base = sorted(base_spans(text))
    more: set[tuple[int, int, int]] = set()
    if "eyJ" in text:
        more |= {(m.start(), 3, m.end()) for m in JWT.finditer(text) if is_jwt(m[0])}
    armoured: list[tuple[int, int]] = []
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            kind = kind_of_pem(m[1], m[2])
            if kind is not None:
                more.add((m.start(), kind, m.end()))
                armoured.append((m.start(), m.end()))
    last = 0
    for m in BASE64.finditer(text):
        at = m.start()
        while armoured and armoured[0][1] <= at:
            armoured.pop(0)
        if at < last or (armoured and armoured[0][0] <= at) or (text[at - 1 : at] in BASE64_CHARS and text[at - 2 : at] not in ("\\n", "\\r")):
            continue
        found = base64_span(text, at)
        if found:
            last = found[0]
            more.add((at, found[1], last))
    for m in DER_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_der(bytes.fromhex(m[0])):
            more.add((m.start(), 4, m.end()))
    return base, sorted({*base, *more})


def told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        found = [spans(t) for t in f["text"]]
        count = lambda k: [sum(x[1] == k for x in base) for base, _ in found]
        yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "n_assign": count(0), "n_access": count(1), "n_hex": count(2), "base_sha256": [hashlib.sha256(told(base).encode()).hexdigest() for base, _ in found], "spans": [told(every) for _, every in found]})


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, a digest of their spans, and all spans."""
    common.importable(docs.sparkSession)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_scan, schema)


def redacted_text(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones together, replaced by mark."""
    if text is None:
        return None
    out, at = [], 0
    for a, _, b in spans(text)[1]:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]]) if out else text


def redacted(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced in text; n_chars follows the text where that column is there."""
    common.importable(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(redacted_text)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
