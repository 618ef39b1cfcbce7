"""Operator 8: secrets found by pattern and confirmed by structure.

Base kinds are plain patterns.  The method then decodes every base64, base64url
or hex candidate and parses what comes out: PEM bodies and bare DER (nested
lengths must add up), SSH wire format (length-prefixed names) and signed-token
headers (JSON with an ``alg``).  Only candidates that parse are reported.  A run
that does not parse is tried again from behind each separator, hex from its
second digit, and base64 wrapped into lines of one width is joined first.  Public
keys and certificates parse too; they are reported as such and never redacted.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base patterns, in the order in which kinds are listed.
BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Runs that can hold the least length: the same matches, found without the short ones.
_QUICK = {"access": re.compile(r"AKIA[A-Z0-9]{12,}"), "hex": re.compile(r"[0-9a-f]{32,}")}
KINDS = [*BASE, "pem", "token", "der", "ssh", "public"]
PUBLIC = KINDS.index("public")

_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)-----([A-Za-z0-9+/=\s\\]+)-----END \1-----")
_TOKEN = re.compile(r"(?<![\w-])(ey[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
_HEX = re.compile(r"[0-9a-fA-F]{48,}")
#: What base64 of an encoded key can start with, behind a separator: a sequence,
#: a string of less than 2^24 bytes, an SSH container.
_START = re.compile(r"(?<=[/_-])(?:M[A-P]|AAAA|b3BlbnNza)")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/]++)++={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/=]+")
# Tags of ASN.1 as DER writes them.
_INTEGER, _BITS, _OCTETS, _OID, _SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
_CONSTRUCTED = 0x20


def unbase64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padding optional; None if invalid."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, start: int, end: int, depth: int = 0) -> list[int] | None:
    """Tags inside data[start:end] in order; None unless all lengths nest exactly."""
    tags: list[int] = []
    while start < end:
        if depth > 12 or end - start < 2:
            return None
        tag, length = data[start], data[start + 1]
        start += 2
        if length & 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or start + size > end or data[start] == 0:
                return None
            length = int.from_bytes(data[start:start + size], "big")
            start += size
            if length < 0x80:
                return None
        if start + length > end:
            return None
        tags.append(tag)
        if tag & _CONSTRUCTED:
            inner = der_items(data, start, start + length, depth + 1)
            if inner is None:
                return None
            tags += inner
        start += length
    return tags


def der_length(head: bytes) -> int:
    """Bytes of the value that starts with ``head``, by its tag and length."""
    if len(head) < 2 or not head[1] & 0x80:
        return 2 + head[1] if len(head) > 1 else 0
    size = head[1] & 0x7F
    return 2 + size + int.from_bytes(head[2:2 + size], "big")


def is_private_der(data: bytes) -> bool:
    """A key that parses is private if it starts with a version number and holds
    more than the two numbers of a public key, or if an algorithm is followed by
    octets (an encrypted key) instead of bits."""
    held = der_items(data, 0, len(data))[1:]
    if held[0] == _INTEGER:
        return len(held) > 2 or _OCTETS in held
    return _BITS not in held


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE that fills the data and holds what key encodings hold:
    integers, or an algorithm's OID with the key as a string of bits or octets."""
    if len(data) < 24 or data[0] != _SEQUENCE:
        return False
    tags = der_items(data, 0, len(data))
    if not tags or tags[0] != _SEQUENCE or tags.count(_SEQUENCE) == 0:
        return False
    held = tags[1:]
    by_numbers = held.count(_INTEGER) >= 2 and set(held) == {_INTEGER}
    by_algorithm = _OID in held and (_BITS in held or _OCTETS in held)
    return by_numbers or by_algorithm or (held[:2] == [_INTEGER, _OCTETS])


def is_ssh_key(data: bytes) -> bool:
    """An SSH private container, or wire strings that fill the data exactly and
    start with an algorithm's name."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, first = 0, None
    while at < len(data):
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at:at + 4], "big")
        if size > len(data) - at - 4:
            return False
        first = data[at + 4:at + 4 + size] if first is None else first
        at += 4 + size
    return first is not None and re.fullmatch(rb"(ssh-|ecdsa-sha2-|sk-)[a-z0-9@.-]+", first) is not None


def is_private_ssh(data: bytes) -> bool:
    return data.startswith(b"openssh-key-v1\0")


def key_kind(data: bytes | None) -> int:
    """Number of the kind that decoded bytes are, 0 for none."""
    if data is None:
        return 0
    if is_der_key(data):
        return 5 if is_private_der(data) else PUBLIC
    if is_ssh_key(data):
        return 6 if is_private_ssh(data) else PUBLIC
    return 0


def inner_key(run: str) -> tuple[int, int]:
    """(start, kind) of the first key behind a separator of a base64 run, (0, 0)
    if there is none.  A start is decoded whole only if the length that its first
    bytes declare fits what follows, so a long run is not decoded for each."""
    end = len(run.rstrip("="))
    for m in _START.finditer(run):
        at = m.start()
        if m[0][0] == "M":
            head = unbase64(run[at:at + 8])
            if head is None or der_length(head) != (end - at) * 3 // 4:
                continue
        elif m[0] == "AAAA":
            head = unbase64(run[at:at + 64]) or b""
            size = int.from_bytes(head[:4], "big")
            if not 4 <= size <= 44 or not re.match(rb"(ssh-|ecdsa-sha2-|sk-)", head[4:]):
                continue
        if end - at >= 32 and (kind := key_kind(unbase64(run[at:end]))):
            return at, kind
    return 0, 0


def is_token_header(part: str) -> bool:
    raw = unbase64(part)
    if raw is None:
        return False
    try:
        head = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, in code points."""
    out = [(m.start(), 0, m.end()) for m in BASE["assign"].finditer(text) if len(m[2]) >= LEAST["assign"]]
    for k, kind in enumerate(("access", "hex"), 1):
        out += [(m.start(), k, m.end()) for m in _QUICK[kind].finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of candidates whose decoded structure parses."""
    out = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            raw = unbase64(re.sub(r"\\n|\\r|\s", "", m[2]))
            if kind := key_kind(raw):
                out.append((m.start(), PUBLIC if kind == PUBLIC else 3, m.end()))
    if "ey" in text:
        out += [(m.start(), 4, m.end()) for m in _TOKEN.finditer(text) if is_token_header(m[1]) and unbase64(m[2]) is not None]
    taken = Taken(out)
    for m in _WRAPPED.finditer(text):
        if taken.holds(m.start()):
            continue
        lines = list(_LINE.finditer(m[0]))
        wide = len(lines[0][0])
        same = next((k for k, x in enumerate(lines) if len(x[0]) != wide), len(lines))
        for n in (same + 1, same):  # the last line may be shorter, or be none of the key's
            if 1 < n <= len(lines) and len(lines[n - 1][0].rstrip("=")) <= wide and (kind := key_kind(unbase64("".join(x[0] for x in lines[:n])))):
                out.append((m.start(), kind, m.start() + lines[n - 1].end()))
                break
    taken = Taken(out)
    for m in _BASE64.finditer(text):
        if taken.holds(m.start()):
            continue
        at, kind = 0, key_kind(unbase64(m[0]))
        if not kind:
            at, kind = inner_key(m[0])
        if kind:
            out.append((m.start() + at, kind, m.end()))
    for m in _HEX.finditer(text):
        if taken.holds(m.start()):
            continue
        for at in (0, 1):
            run = m[0][at:len(m[0]) - (len(m[0]) - at) % 2]
            if len(run) >= 48 and (kind := key_kind(bytes.fromhex(run))):
                out.append((m.start() + at, kind, m.start() + at + len(run)))
                break
    return out


class Taken:
    """Spans already reported; whether one of them holds a place."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.start, self.end, most = [], [], 0
        for s, _, e in sorted(spans):
            most = max(most, e)
            self.start.append(s)
            self.end.append(most)

    def holds(self, place: int) -> bool:
        k = bisect_right(self.start, place)
        return k > 0 and place < self.end[k - 1]


def spans_of(text: str | None) -> list[tuple[int, int, int]]:
    return sorted({*base_spans(text), *confirmed_spans(text)}) if text else []


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def secret_spans(text: Column) -> Column:
    """Spans in one text, by start and then kind; code points, end exclusive.

    Null and empty texts have none.  Texts are scanned whole, one Arrow batch
    at a time; spans of different kinds may overlap.
    """
    @F.arrow_udf(_SPANS)
    def find(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(t)] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(kind))

    return find(text.cast("string"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every secret replaced by ``mark``; overlapping spans become
    one, public keys stay.  Rows and columns stay, repeated rows too; null and
    empty texts stay as they are."""
    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            spans = [x for x in spans_of(t) if x[1] != PUBLIC] if t else []
            if spans:
                parts, at = [], 0
                for s, _, e in spans:
                    if s >= at:
                        parts += [t[at:s], mark]
                    at = max(at, e)
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pa.array(out, pa.string())

    return df.withColumn(text_col, clean(F.col(f"`{text_col}`").cast("string")))
