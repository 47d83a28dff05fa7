"""Secret scan: candidates by pattern, encoded keys and signed tokens confirmed by their structure before reporting."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(?a)(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "signed_token", "private_key", "encoded_key")
MASK = "[SECRET]"

_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s\\nr]+)-----END \1-----")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
_OPENSSH = b"openssh-key-v1\x00"
_SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")


def _length(data: bytes, at: int) -> tuple[int, int] | None:
    """A definite DER length and where its content begins."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    size = first & 0x7F
    if not 1 <= size <= 4 or at + 1 + size > len(data):
        return None
    n = int.from_bytes(data[at + 1:at + 1 + size], "big")
    return (n, at + 1 + size) if n >= 0x80 else None


def _elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of DER elements that fill `data` exactly."""
    found, at = [], 0
    while at < len(data):
        sized = _length(data, at + 1)
        if sized is None or sized[1] + sized[0] > len(data):
            return None
        found.append((data[at], data[sized[1]:sized[1] + sized[0]]))
        at = sized[1] + sized[0]
    return found


def is_der_key(data: bytes) -> bool:
    """One sequence whose nested lengths fit, opening with a version, a key identifier or a modulus."""
    outer = _elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = _elements(outer[0][1])
    if not inner or len(inner) < 2:
        return False
    tag, content = inner[0]
    if tag == 0x30:                                  # algorithm, then the key's bits
        name = _elements(content)
        return bool(name) and name[0][0] == 0x06 and inner[1][0] in (0x03, 0x04)
    return tag == 0x02 and 0 < len(content) and inner[1][0] in (0x02, 0x04, 0x30)


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields that fill the data, the first one a known key name; or the private key container."""
    if data.startswith(_OPENSSH):
        at, fields = len(_OPENSSH), 0
        while fields < 3 and at + 4 <= len(data):
            at += 4 + int.from_bytes(data[at:at + 4], "big")
            fields += 1
        return fields == 3 and at <= len(data)
    fields, at = [], 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + n > len(data):
            return False
        fields.append(data[at + 4:at + 4 + n])
        at += 4 + n
    return at == len(data) and len(fields) >= 2 and fields[0] in _SSH_NAMES


def decode_base64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_key(data: bytes | None, depth: int = 2) -> bool:
    """A key encoding, bare or wrapped in base64 or hex again."""
    if not data:
        return False
    if is_der_key(data) or is_ssh_key(data):
        return True
    if depth and len(data) >= 40 and data.isascii():
        text = data.decode("ascii").strip()
        if _HEX_RUN.fullmatch(text):
            return is_key(bytes.fromhex(text), depth - 1)
        if _BASE64.fullmatch(text):
            return is_key(decode_base64(text), depth - 1)
        return "PRIVATE KEY-----" in text
    return False


def is_signed_token(text: str) -> bool:
    """A header that names its algorithm, a payload that is an object, and a signature unless the algorithm is none."""
    head, body, mark = text.split(".")
    try:
        header, payload = (json.loads(decode_base64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str) or not isinstance(payload, dict):
        return False
    return len(mark) >= 16 or header["alg"].lower() == "none"


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a whole text, in code points, by start and then kind as listed in KINDS."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "eyJ" in text:
        found += [(m.start(), m.end(), "signed_token") for m in _TOKEN.finditer(text) if is_signed_token(m[0])]
    if "-----BEGIN" in text:
        for m in _ARMOUR.finditer(text):
            body = re.sub(r"\\[nr]|\s", "", m[2])
            if is_key(decode_base64(body)):
                found.append((m.start(), m.end(), "private_key"))
    found += [(m.start(), m.end(), "encoded_key") for m in _BASE64.finditer(text) if is_key(decode_base64(m[0]))]
    found += [(m.start(), m.end(), "encoded_key") for m in _HEX_RUN.finditer(text) if is_key(bytes.fromhex(m[0]))]
    return sorted(set(found), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(found) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for every row of `docs`.

    Base kinds are patterns; a signed token, an armoured private key and an encoded key are reported only after their
    decoded form was parsed: JSON header with an algorithm, nested DER lengths that fit, or length-prefixed key fields.
    Kinds may overlap. Null or empty text: no spans. Repeated rows and null ids are rows like any other. Empty table:
    empty result. Other columns are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [spans(t.as_py() or "") for t in batch.column(1)]
            base = [[s for s in r if s[2] in BASE] for r in rows]
            counts = [pa.array([sum(s[2] == k for s in r) for r in base], type=pa.int64()) for k in BASE]
            digest = pa.array([hashlib.sha256(_joined(r).encode()).hexdigest() for r in base], type=pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array(map(_joined, rows), type=pa.string())],
                                             ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(
        run, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str) -> str:
    """The text with every reported stretch replaced by MASK; overlapping spans become one."""
    out, at = [], 0
    for a, b, _ in spans(text):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """`docs` with secrets masked in the text column; rows and columns stay. Null stays null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text)
            kept = batch.column(i)
            made = [t if t is None else masked(t) for t in kept.to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(made, type=kept.type))

    return docs.mapInArrow(run, docs.schema)
