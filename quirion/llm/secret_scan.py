"""Secret scan: pattern candidates, and structural confirmation of encoded keys and signed tokens.

Three base kinds are found by pattern alone (``assign``, ``access``, ``hex``). On top of these, base64 and hex
candidates are decoded and parsed before they are reported: ``jwt`` needs a JSON header that names an algorithm and a
JSON payload, ``der`` needs a private-key structure whose nested lengths fill each other exactly, ``ssh`` needs the
length-prefixed fields of an OpenSSH private key. A key may start at any character of a run of its alphabet, which may be
broken over lines, and ends by its own lengths. A PEM block counts by what its body decodes to, headers left out.

Spans are ``kind:start:end`` in code points, end exclusive, ordered by start and then by kind as in ``KINDS``.

Defined results: a null text counts as empty (no spans); repeated rows are scanned each; an empty table gives an empty
result; other columns are ignored. Each document is scanned whole by one task, with no shuffle.
"""

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

from quirion.llm import common

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "der", "ssh")

# Letters of the key word match in either case, ASCII only. A match of too short a value is dropped but still consumes.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_LEAST = 12
# These two consist of one greedy run, so asking for the least length at once finds the same spans.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

# Three dotted runs; every run that may be a header is looked at, also one inside a longer dotted name.
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*))")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[^-]|-(?!----))*)-----END \1-----")
_PEM_HEADER = re.compile(r"^[A-Za-z0-9-]+:[^\n]*(?:\n[ \t][^\n]*)*$", re.M)
# Runs of an alphabet, which may be broken over lines, also as a quoted string a line or with written line breaks.
_BREAK = r"""["']?[ \t]*[+,\\]?[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t>#*]*["']?"""
_RUN64 = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}(?:{_BREAK}[A-Za-z0-9+/_-]+)*")
_RUN16 = re.compile(rf"(?<![0-9a-fA-F])[0-9a-fA-F]{{16,}}(?:{_BREAK}[0-9a-fA-F]+)*")
_PIECE64, _PIECE16 = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9a-fA-F]+")
_BREAKS = re.compile(_BREAK)
#: Characters that a broken or whole run needs to hold a key.
_LEAST64, _LEAST16 = 24, 48
# A sequence, and in it at once a version of 0 or 1, or another sequence.
_DER = re.compile(rb"\x30(?:[\x00-\x7f]|\x81.|\x82..|\x83...|\x84....)(?=\x02\x01[\x00\x01]|\x30)", re.S)
_SSH_MARK = b"openssh-key-v1\0"

_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def decoded64(run: str) -> bytes:
    """The bytes of a base64 run in either alphabet; empty if it isn't one."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return b""
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the DER item at ``at``; None if it doesn't fit before ``end``."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None  # not the shortest form
    return (tag, at, at + size) if at + size <= end else None


def der_children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The items that fill a content exactly, or None."""
    found, at = [], start
    while at < end:
        item = der_item(data, at, end)
        if item is None:
            return None
        found.append(item)
        at = item[2]
    return found


def der_key(data: bytes, at: int = 0) -> int | None:
    """The end of the DER private key at ``at``, by its own length; None if there is none.

    RSA, DSA, elliptic curve, and either wrapped form.
    """
    top = der_item(data, at, len(data))
    return top[2] if top is not None and top[0] == _SEQUENCE and _is_key(data, top) else None


def _is_key(data: bytes, top: tuple[int, int, int]) -> bool:
    parts = der_children(data, top[1], top[2])
    if not parts:
        return False
    tags = [t for t, _, _ in parts]
    if tags[0] == _SEQUENCE and tags[1:] == [_OCTETS]:  # encrypted: algorithm and payload
        inner = der_children(data, *parts[0][1:])
        return bool(inner) and inner[0][0] == _OID and len(inner) == 2
    if tags[0] != _INTEGER or parts[0][2] - parts[0][1] != 1:
        return False
    version = data[parts[0][1]]
    if version > 1:
        return False
    if all(t == _INTEGER for t in tags):
        return len(tags) in (6, 9)
    if len(tags) >= 3 and tags[1] == _SEQUENCE and tags[2] == _OCTETS:
        inner = der_children(data, *parts[1][1:])
        return bool(inner) and inner[0][0] == _OID
    return version == 1 and tags[1] == _OCTETS and all(t in (0xA0, 0xA1) for t in tags[2:]) and parts[1][2] - parts[1][1] >= 16


def ssh_key(data: bytes, at: int = 0) -> int | None:
    """The end of the OpenSSH private key at ``at``: mark, cipher, kdf, options, count, public and private parts."""
    if not data.startswith(_SSH_MARK, at):
        return None
    at += len(_SSH_MARK)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        return data[at - size : at] if at <= len(data) else None

    for _ in range(3):
        if field() is None:
            return None
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= count <= 16:
        return None
    return at if all(field() for _ in range(count + 1)) else None


def keys_in(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of each key in the bytes, wherever it starts."""
    for m in _DER.finditer(data):
        end = der_key(data, m.start())
        if end is not None:
            yield "der", m.start(), end
    at = data.find(_SSH_MARK)
    while at >= 0:
        end = ssh_key(data, at)
        if end is not None:
            yield "ssh", at, end
        at = data.find(_SSH_MARK, at + 1)


def signed_token(head: str, body: str) -> int | None:
    """Where in ``head`` the header of a signed token starts; None if there is none.

    The header is a JSON object that names an algorithm and ends where ``head`` ends, the body a JSON object.
    """
    try:
        payload = json.loads(decoded64(body))
    except (ValueError, RecursionError):
        return None
    if not isinstance(payload, dict):
        return None
    found = []
    for skip in range(4):  # the header may start at any character
        data = decoded64(head[skip:])
        at = data.find(b"{")
        while at >= 0:
            if at % 3 == 0:
                try:
                    header = json.loads(data[at:])
                except (ValueError, RecursionError):
                    header = None
                if isinstance(header, dict) and isinstance(header.get("alg"), str):
                    found.append(skip + at // 3 * 4)
            at = data.find(b"{", at + 1)
    return min(found, default=None)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the three base kinds."""
    found = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _ASSIGN_LEAST]
    found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return found


def _joined(text: str, run: re.Match, piece: re.Pattern) -> tuple[str, list[int]]:
    """The characters of a run without its line breaks, and the place of each in the text."""
    parts, places, at = [], [], run.start()
    while at < run.end():
        m = piece.match(text, at)
        if m is None:
            at = _BREAKS.match(text, at).end()
            continue
        parts.append(m[0])
        places += range(m.start(), m.end())
        at = m.end()
    return "".join(parts), places


def encoded_keys(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of each key in base64 or hex that starts at any character of a run and ends inside it."""
    found = []
    for m in _RUN64.finditer(text):
        if m.end() - m.start() < _LEAST64:
            continue
        chars, places = _joined(text, m, _PIECE64)
        for skip in range(4):
            whole = len(chars) - skip
            data = decoded64(chars[skip : skip + whole - (whole % 4 == 1)])
            for kind, a, b in keys_in(data):
                if a % 3 == 0:
                    end = places[skip + -(-b * 4 // 3) - 1] + 1
                    padding = -(b - a) % 3
                    found.append((places[skip + a // 3 * 4], kind, end + padding * (text[end : end + padding] == "=" * padding)))
    for m in _RUN16.finditer(text):
        if m.end() - m.start() < _LEAST16:
            continue
        chars, places = _joined(text, m, _PIECE16)
        for skip in range(2):
            size = (len(chars) - skip) // 2 * 2
            for kind, a, b in keys_in(bytes.fromhex(chars[skip : skip + size])):
                found.append((places[skip + 2 * a], kind, places[skip + 2 * b - 1] + 1))
    return found


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what decodes to a key or a signed token. Of a key inside a key, the outer one is given."""
    found = []
    for m in _DOTTED.finditer(text):
        at = signed_token(m[1], m[2])
        if at is not None:
            found.append((m.start() + at, "jwt", m.end(3)))
    keys = []
    for m in _PEM.finditer(text):
        data = decoded64(re.sub(r"\\n|\\r|\s", "", _PEM_HEADER.sub("", m[2])))
        kind = "der" if der_key(data) == len(data) > 0 else "ssh" if ssh_key(data) == len(data) > 0 else None
        if kind:
            keys.append((m.start(), kind, m.end()))
    keys += encoded_keys(text)
    until = -1
    for a, kind, b in sorted(set(keys), key=lambda k: (k[0], -k[2], k[1])):
        if b > until:
            found.append((a, kind, b))
            until = b
    return found


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, and all spans."""
    given = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    id_type = given.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                for k, kind in enumerate(BASE_KINDS):
                    counts[k].append(sum(s[1] == kind for s in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(base + confirmed_spans(text)))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    found = given.mapInArrow(run, f"id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return found.withColumnRenamed("id", id_col)
