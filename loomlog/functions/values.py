"""Typed values of binary XML as text.

Every renderer gets the whole chunk, the offset of the value and its length in bytes. Fixed-size types
read their natural width from the chunk, whatever length was declared.
"""

from __future__ import annotations

import re
import struct
from codecs import utf_16_le_decode
from collections.abc import Callable
from datetime import date, timedelta
from decimal import Decimal

# Type codes of the format.
NULL, STRING, ANSI, BOOL, BINARY, GUID, SIZE, FILETIME, SYSTEMTIME, SID, HEX32, HEX64, BINXML = 0x00, 0x01, 0x02, 0x0D, 0x0E, 0x0F, 0x10, 0x11, 0x12, 0x13, 0x14, 0x15, 0x21
#: Numbers by type code, as struct formats.
NUMBERS = {0x03: "<b", 0x04: "<B", 0x05: "<h", 0x06: "<H", 0x07: "<i", 0x08: "<I", 0x09: "<q", 0x0A: "<Q", 0x0B: "<f", 0x0C: "<d"}
ARRAY = 0x80
_EPOCH_DAYS = 134774  # from 1601-01-01 to 1970-01-01
_C1 = {0x81, 0x8D, 0x8F, 0x90, 0x9D}
_ANSI_TABLE = "".join(chr(b) if b in _C1 else bytes([b]).decode("cp1252") for b in range(256))
_ESCAPED = re.compile("[&<>\"']").search
_ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"})


class OutOfChunk(Exception):
    """A read beyond the chunk; ends the decoding of a record."""

    def __init__(self) -> None:
        super().__init__("Offset is outside the bounds of the DataView")


def escape(text: str) -> str:
    return text.translate(_ESCAPES) if _ESCAPED(text) else text


def unpack(fmt: str, chunk: bytes, at: int) -> int | float:
    try:
        return struct.unpack_from(fmt, chunk, at)[0]
    except struct.error:
        raise OutOfChunk from None


def utf16(raw: bytes) -> str:
    """UTF-16LE with U+FFFD for what is no text, without a leading byte order mark."""
    return utf_16_le_decode(raw, "replace", True)[0].removeprefix("﻿")


def ansi(raw: bytes) -> str:
    return "".join(_ANSI_TABLE[b] for b in raw)


def number_text(x: float) -> str:
    """Shortest decimal text of a double, in the notation of ECMAScript."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if -6 < point <= 0:
        body = "0." + "0" * -point + text
    elif 0 < point <= 21:
        body = text.ljust(point, "0") if len(text) <= point else f"{text[:point]}.{text[point:]}"
    else:
        power = point - 1
        body = text[0] + (f".{text[1:]}" if len(text) > 1 else "") + f"e{'+' if power > 0 else '-'}{abs(power)}"
    return "-" * sign + body


def civil(days: int) -> tuple[int, int, int]:
    """Year, month and day of a day number since 1970; years may pass 9999."""
    cycles, rest = divmod(days + 719162, 146097)  # days of 400 years, from 0001-01-01
    d = date(1, 1, 1) + timedelta(days=rest)
    return d.year + 400 * cycles, d.month, d.day


def filetime_text(ticks: int) -> str:
    """ISO text with seven digits of a count of 100 ns since 1601; zero is empty."""
    if not ticks:
        return ""
    seconds, fraction = divmod(ticks, 10_000_000)
    days, seconds = divmod(seconds, 86_400)
    y, m, d = civil(days - _EPOCH_DAYS)
    return f"{y:04d}-{m:02d}-{d:02d}T{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}.{fraction:07d}Z"


def guid_text(raw: bytes) -> str:
    a, b, c = struct.unpack("<IHH", raw[:8])
    return f"{{{a:08x}-{b:04x}-{c:04x}-{raw[8:10].hex().upper()}-{raw[10:16].hex().upper()}}}"


def _number(fmt: str) -> Callable[[bytes, int, int], str]:
    if fmt in ("<f", "<d"):
        return lambda chunk, at, size: number_text(unpack(fmt, chunk, at))
    return lambda chunk, at, size: str(unpack(fmt, chunk, at))


def string(chunk: bytes, at: int, size: int) -> str:
    """Text of a ``STRING``."""
    text = utf16(chunk[at : at + size])
    return escape(text[:-1] if text[-1:] == "\0" else text)


def _ansi_string(chunk: bytes, at: int, size: int) -> str:
    return escape(ansi(chunk[at : at + size]).removesuffix("\0"))


def _hex(width: int) -> Callable[[bytes, int, int], str]:
    fmt = "<Q" if width == 16 else "<I"
    return lambda chunk, at, size: f"0x{unpack(fmt, chunk, at):0{width}x}"


def _system_time(chunk: bytes, at: int, size: int) -> str:
    if size < 16:
        return ""
    y, mo, _, d, h, mi, s, ms = (unpack("<H", chunk, at + i) for i in range(0, 16, 2))
    return f"{y}-{mo:02d}-{d:02d}T{h:02d}:{mi:02d}:{s:02d}.{ms:03d}Z"


def _sid(chunk: bytes, at: int, size: int) -> str:
    if size < 8:
        return ""
    raw = chunk[at : at + size]
    subs = [unpack("<I", raw, i) for i in range(8, size - 3, 4)][: raw[1]]
    return "-".join(["S", str(raw[0]), str(int.from_bytes(raw[2:8], "big")), *map(str, subs)])


RENDERERS: dict[int, Callable[[bytes, int, int], str]] = {
    NULL: lambda chunk, at, size: "",
    STRING: string,
    ANSI: _ansi_string,
    **{code: _number(fmt) for code, fmt in NUMBERS.items()},
    BOOL: lambda chunk, at, size: "true" if unpack("<I", chunk, at) else "false",
    BINARY: lambda chunk, at, size: chunk[at : at + size].hex().upper(),
    GUID: lambda chunk, at, size: guid_text(chunk[at : at + 16]) if size >= 16 else "",
    SIZE: lambda chunk, at, size: _hex(16 if size == 8 else 8)(chunk, at, size),
    FILETIME: lambda chunk, at, size: filetime_text(unpack("<Q", chunk, at)) if size >= 8 else "",
    SYSTEMTIME: _system_time,
    SID: _sid,
    HEX32: _hex(8),
    HEX64: _hex(16),
}
#: Type codes whose text has no raw markup: all but nested documents and unknown ones.
PLAIN = frozenset(RENDERERS) | frozenset(range(ARRAY, 256))
#: Bytes of one element, for the types that have arrays of fixed-size elements.
ELEMENT = {code: struct.calcsize(fmt) for code, fmt in NUMBERS.items()} | {HEX32: 4, HEX64: 8, FILETIME: 8, GUID: 16, SYSTEMTIME: 16}


def render(chunk: bytes, at: int, size: int, kind: int) -> str:
    """Text of a value other than nested binary XML; no bytes, no text."""
    if not size:
        return ""
    if kind & ARRAY:
        base = kind & ~ARRAY
        if base == STRING:
            return escape(", ".join(filter(None, utf16(chunk[at : at + size]).split("\0"))))
        step = ELEMENT.get(base, 0)
        if step and size >= step:
            return ", ".join(RENDERERS[base](chunk, i, step) for i in range(at, at + size - step + 1, step))
        return chunk[at : at + size].hex().upper()
    if kind in RENDERERS:
        return RENDERERS[kind](chunk, at, size)
    return f"<!-- unknown type 0x{kind:02X} -->{chunk[at : at + size].hex().upper()}"
