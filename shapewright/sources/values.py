"""Documents as Python values: JSON with its number forms, CBOR (RFC 8949), and CSV (RFC 4180) with coerced fields.

Integers are int, other numbers float, text str, byte strings bytes; maps are ``Map``, which keeps pairs in order and repeated keys.
"""

from __future__ import annotations

import csv
import io
import json
import math
import re
import struct
import sys
from dataclasses import dataclass


class DecodeError(ValueError):
    """A document that isn't well formed: its kind is "end", "syntax", "content" or "depth", and where it was seen, if known."""

    def __init__(self, text: str, kind: str = "syntax", offset: int | None = None):
        super().__init__(text)
        self.kind, self.offset = kind, offset


@dataclass(frozen=True)
class Map:
    pairs: tuple[tuple[object, object], ...]


@dataclass(frozen=True)
class Tag:
    number: int
    value: object


@dataclass(frozen=True)
class Simple:
    """A simple value other than booleans, null and undefined."""

    number: int


class _Undefined:
    def __repr__(self) -> str:
        return "undefined"


UNDEFINED = _Undefined()


#: Arrays and maps within each other that a document may have at most, in all formats; Spark's own JSON parser takes as many.
NESTED = 999


def _number(text: str) -> float:
    x = float(text)
    if math.isinf(x):
        raise ValueError("a number out of range")
    return x


def _integer(text: str):
    n = int(text) if len(text) <= 20 else None
    return n if n is not None and -(1 << 63) <= n < 1 << 64 else _number(text)


_STRINGS = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_SURROGATES = re.compile(r"\\u[dD][89a-fA-F]")


def _too_deep(text: str) -> bool:
    """Whether brackets of a JSON text are nested beyond the limit."""
    if text.count("[") + text.count("{") <= NESTED:
        return False
    depth = 0
    for c in _STRINGS.sub("", text):
        depth += (c in "[{") - (c in "]}")
        if depth > NESTED:
            return True
    return False


def _halved(value) -> bool:
    """Whether a text in a document has half of a surrogate pair."""
    stack = [value]
    while stack:
        v = stack.pop()
        if type(v) is str:
            if not v.isascii() and any("\ud800" <= c <= "\udfff" for c in v):
                return True
        elif type(v) is list:
            stack += v
        elif type(v) is Map:
            stack += [x for pair in v.pairs for x in pair]
    return False


def _constant(text: str):
    raise ValueError(f"{text} isn't JSON")


def _pairs(found: list[tuple[str, object]]) -> Map:
    return Map(tuple(sorted(dict(found).items())))


_DECODER = json.JSONDecoder(object_pairs_hook=_pairs, parse_int=_integer, parse_float=_number, parse_constant=_constant)
_ENCODER = json.JSONEncoder(ensure_ascii=False, allow_nan=False)


def from_json(text: str):
    """A JSON document; keys are sorted, of equal keys the last one counts."""
    if _too_deep(text):
        raise DecodeError("nested too deeply", "depth")
    try:
        if text.startswith("\ufeff"):
            raise json.JSONDecodeError("Unexpected UTF-8 BOM (decode using utf-8-sig)", text, 0)
        value = _DECODER.decode(text)
    except (ValueError, RecursionError) as e:
        raise DecodeError(str(e), "depth" if isinstance(e, RecursionError) else "syntax", getattr(e, "pos", None)) from None
    if _SURROGATES.search(text) and _halved(value):
        raise DecodeError("half of a surrogate pair", "content")
    return value


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        if len(part) < n:
            raise DecodeError(f"the document ends inside an item, at byte {len(self.data)}", "end", len(self.data))
        self.at += n
        return part

    def chunk(self, depth: int):
        """A part of a string of unknown length, which has a length itself."""
        if self.data[self.at : self.at + 1] in (b"\x5f", b"\x7f"):
            raise DecodeError(f"chunks within a chunk at byte {self.at}", "syntax", self.at)
        return self.item(depth, True)

    def item(self, depth: int = 0, stop: bool = False):
        if depth > NESTED:
            raise DecodeError("nested too deeply", "depth", self.at)
        at = self.at
        first = self.take(1)[0]
        major, info = first >> 5, first & 31
        if first == 0xFF:
            if stop:
                return _BREAK
            raise DecodeError(f"a break at byte {at}", "syntax", at)
        if info < 24:
            n = info
        elif info < 28:
            n = int.from_bytes(self.take(1 << (info - 24)), "big")
        elif info == 31 and major in (2, 3, 4, 5):
            n = None
        else:
            raise DecodeError(f"a reserved head at byte {at}", "syntax", at)
        if major == 0:
            return n
        if major == 1:
            return -1 - n
        if major in (2, 3):
            if n is None:
                parts = []
                while (part := self.chunk(depth + 1)) is not _BREAK:
                    if type(part) is not (bytes if major == 2 else str):
                        raise DecodeError(f"a chunk of another kind before byte {self.at}", "content", self.at)
                    parts.append(part)
                return (b"" if major == 2 else "").join(parts)
            part = self.take(n)
            if major == 2:
                return part
            try:
                return part.decode()
            except UnicodeDecodeError:
                raise DecodeError(f"text that isn't UTF-8 at byte {at}", "content", at) from None
        if major == 4:
            out = []
            while n is None or len(out) < n:
                v = self.item(depth + 1, n is None)
                if v is _BREAK:
                    break
                out.append(v)
            return out
        if major == 5:
            out = []
            while n is None or len(out) < n:
                k = self.item(depth + 1, n is None)
                if k is _BREAK:
                    break
                out.append((k, self.item(depth + 1)))
            return Map(tuple(out))
        if major == 6:
            return Tag(n, self.item(depth + 1))
        if info == 25:
            return struct.unpack(">e", n.to_bytes(2, "big"))[0]
        if info == 26:
            return struct.unpack(">f", n.to_bytes(4, "big"))[0]
        if info == 27:
            return struct.unpack(">d", n.to_bytes(8, "big"))[0]
        if info == 24 and n < 32:
            raise DecodeError(f"a simple value of two bytes at byte {at}", "content", at)
        return {20: False, 21: True, 22: None, 23: UNDEFINED}.get(n, Simple(n))


_BREAK = object()


def _deep(read):
    """read() with room for as many calls within calls as documents may be deep."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 5 * NESTED))
    try:
        return read()
    finally:
        sys.setrecursionlimit(limit)


def from_cbor(data: bytes, allow_trailing: bool = False):
    """The one item that data hold."""
    reader = _Reader(bytes(data))
    value = _deep(reader.item)
    if reader.at != len(data) and not allow_trailing:
        raise DecodeError(f"bytes follow the item, from byte {reader.at} on", "syntax", reader.at)
    return value


def sequence_from_cbor(data: bytes) -> list:
    """All items of a CBOR sequence (RFC 8742)."""
    reader, out = _Reader(bytes(data)), []
    while reader.at < len(data):
        out.append(_deep(reader.item))
    return out


def to_cbor(value) -> bytes:
    """Deterministic encoding, for samples and tests."""

    def head(major: int, n: int) -> bytes:
        if n < 24:
            return bytes([major << 5 | n])
        for k, size in enumerate((1, 2, 4, 8)):
            if n < 1 << (8 * size):
                return bytes([major << 5 | (24 + k)]) + n.to_bytes(size, "big")
        raise ValueError("number too large for a head")

    if value is False or value is True or value is None or value is UNDEFINED:
        return bytes([0xE0 | {False: 20, True: 21, None: 22}.get(value, 23)]) if value is not UNDEFINED else b"\xf7"
    if isinstance(value, int):
        if not -(1 << 64) <= value < 1 << 64:
            tag, n = (2, value) if value > 0 else (3, -1 - value)
            return head(6, tag) + to_cbor(n.to_bytes((n.bit_length() + 7) // 8, "big"))
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, bytes):
        return head(2, len(value)) + value
    if isinstance(value, str):
        return head(3, len(value.encode())) + value.encode()
    if isinstance(value, list):
        return head(4, len(value)) + b"".join(map(to_cbor, value))
    if isinstance(value, Map):
        return head(5, len(value.pairs)) + b"".join(to_cbor(k) + to_cbor(v) for k, v in value.pairs)
    if isinstance(value, Tag):
        return head(6, value.number) + to_cbor(value.value)
    if isinstance(value, Simple):
        return head(7, value.number)
    raise TypeError(type(value))


def to_json(value) -> str:
    """JSON text of a value whose maps have text keys."""

    def plain(v):
        if isinstance(v, Map):
            return {k: plain(x) for k, x in v.pairs}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return v

    return _ENCODER.encode(plain(value))


def cbor_from_text(text: str) -> bytes:
    """Bytes from hex digits (with separators between) or base 64."""
    digits = re.sub(r"(?i)0x|[\s,:;_-]", "", text)
    if re.fullmatch(r"(?:[0-9A-Fa-f]{2})*", digits):
        return bytes.fromhex(digits)
    import base64

    body = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except ValueError:
        raise DecodeError("neither hex digits nor base 64", "content") from None


def csv_records(text: str) -> list[list[str]]:
    """Records of CSV text; they may differ in length. Empty lines are no records."""
    csv.field_size_limit(1 << 30)
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


_BEGINNINGS = frozenset("+-.0123456789")
_SINT = re.compile(r"[+-]?[0-9]+")
_FLOAT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")


def coerced(field: str):
    """A CSV field as an integer of 64 bits, a finite float, or text."""
    if field[:1] not in _BEGINNINGS:
        return field
    if _SINT.fullmatch(field) and len(field.lstrip("+-0")) <= 20:
        n = int(field.lstrip("+-0") or "0") * (-1 if field[0] == "-" else 1)
        if -(1 << 63) <= n < 1 << 64:
            return n
    if _FLOAT.fullmatch(field) and math.isfinite(float(field)):
        return float(field)
    return field


def from_csv(text: str, has_header: bool = False) -> list[list]:
    """CSV text as an array of records; with ``has_header`` the first one stays text."""
    return [list(r) if has_header and i == 0 else [coerced(f) for f in r] for i, r in enumerate(csv_records(text))]
