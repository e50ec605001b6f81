"""Containers from rows: the inverse of decoding, for fixtures, round trips and exports.

Each chunk holds its template inline in the first record; later records refer back to it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

from .binxml import CHUNK_SIZE

UINT64, STRING_KIND = 0x0A, 0x01


def _text(s: str) -> bytes:
    return s.encode("utf-16-le")


def file_header(*, flags: int = 0, block: int = 4096) -> bytes:
    head = bytearray(block)
    head[:8] = b"ElfFile\0"
    struct.pack_into("<H", head, 40, block)
    struct.pack_into("<I", head, 120, flags)
    return bytes(head)


class Body:
    """Bytes of template content at a known offset in the chunk; names are put inline."""

    def __init__(self, at: int) -> None:
        self.at, self.out = at, bytearray()

    def raw(self, data: bytes) -> Body:
        self.out += data
        return self

    def name(self, name: str) -> Body:
        here = self.at + len(self.out) + 4
        return self.raw(struct.pack("<I", here) + struct.pack("<IHH", 0, 0, len(name)) + _text(name) + b"\0\0")

    def value(self, text: str) -> Body:
        return self.raw(b"\x05\x01" + struct.pack("<H", len(text)) + _text(text))

    def slot(self, number: int, kind: int = STRING_KIND, optional: bool = False) -> Body:
        return self.raw(struct.pack("<BHB", 0x0E if optional else 0x0D, number, kind))

    def open(self, name: str, attributes: Sequence[tuple[str, str | int]] = ()) -> Body:
        self.raw(struct.pack("<BHI", 0x41 if attributes else 0x01, 0xFFFF, 0)).name(name)
        if attributes:
            size_at = len(self.out)
            self.raw(bytes(4))
            for key, value in attributes:
                self.raw(b"\x06").name(key)
                self.slot(value) if isinstance(value, int) else self.value(value)
            struct.pack_into("<I", self.out, size_at, len(self.out) - size_at - 4)
        return self

    def start(self) -> Body:
        return self.raw(b"\x02")

    def empty(self) -> Body:
        return self.raw(b"\x03")

    def end(self) -> Body:
        return self.raw(b"\x04")


#: Slots of the standard event template.
SLOTS = ("provider", "event_id", "level", "channel", "computer", "event_data")


def event_template(at: int) -> bytes:
    """An Event element with the fields of ``SLOTS``, as template content at an offset of the chunk."""
    b = Body(at).raw(b"\x0f\x01\x01\x00").open("Event").start().open("System").start()
    b.open("Provider", (("Name", 0),)).empty()
    for name, slot in (("EventID", 1), ("Level", 2), ("Channel", 3), ("Computer", 4)):
        b.open(name).start().slot(slot).end()
    b.end().open("EventData").start().open("Data").start().slot(5).end().end().end().raw(b"\0")
    return bytes(b.out)


def template_use(at: int, definition: int | None, values: Sequence[tuple[int, bytes]], *, guid: uuid.UUID, body=event_template) -> tuple[bytes, int]:
    """Payload of a record at an offset of the chunk, and the offset of its definition."""
    head = b"\x0f\x01\x01\x00\x0c\x01" + bytes(4)
    inline = b""
    if definition is None:
        definition = at + len(head) + 4
        content = body(definition + 24)
        inline = struct.pack("<I", 0) + guid.bytes_le + struct.pack("<I", len(content)) + content
    kinds = b"".join(struct.pack("<HBB", len(v), k, 0) for k, v in values)
    return head + struct.pack("<I", definition) + inline + struct.pack("<I", len(values)) + kinds + b"".join(v for _, v in values) + b"\0", definition


def record(record_id: int, ticks: int, payload: bytes, *, size_copy: int | None = None) -> bytes:
    size = len(payload) + 28
    return struct.pack("<IIQQ", 0x2A2A, size, record_id, ticks) + payload + struct.pack("<I", size if size_copy is None else size_copy)


@dataclass
class ChunkWriter:
    """Fills one chunk; ``add`` tells whether the event still fitted."""

    guid: uuid.UUID = uuid.UUID("0c4e1f2a-58d3-4b6e-9a77-d2f10b3c4e5f")
    definition: int | None = None
    body: bytearray = field(default_factory=bytearray)
    ids: list[int] = field(default_factory=list)
    last: int = 512

    def put(self, record_id: int, raw: bytes) -> bool:
        if 512 + len(self.body) + len(raw) > CHUNK_SIZE:
            return False
        self.last = 512 + len(self.body)
        self.body += raw
        self.ids.append(record_id)
        return True

    def add(self, record_id: int, ticks: int, values: Sequence[tuple[int, bytes]]) -> bool:
        payload, definition = template_use(512 + len(self.body) + 24, self.definition, values, guid=self.guid)
        if not self.put(record_id, record(record_id, ticks, payload)):
            return False
        self.definition = definition
        return True

    def bytes(self, *, flags: int = 0, first: int | None = None, last: int | None = None, pointers: dict[int, int] | None = None) -> bytes:
        first = (self.ids or [1])[0] if first is None else first
        last = (self.ids or [0])[-1] if last is None else last
        head = bytearray(512)
        head[:8] = b"ElfChnk\0"
        struct.pack_into("<QQQQIIII", head, 8, first, last, first, last, 128, self.last, 512 + len(self.body), zlib.crc32(self.body))
        struct.pack_into("<I", head, 120, flags)
        for bucket, at in (pointers or {}).items():
            struct.pack_into("<I", head, 384 + 4 * bucket, at)
        struct.pack_into("<I", head, 124, zlib.crc32(head[:120] + head[128:512]))
        return (bytes(head) + bytes(self.body)).ljust(CHUNK_SIZE, b"\0")


def event_values(event: dict) -> list[tuple[int, bytes]]:
    return [(STRING_KIND, _text(str(event[n]))) for n in SLOTS]


def encode(events: Iterable[dict]) -> Iterator[bytes]:
    """The header and chunks of a container of ``events`` with record_id, ticks and ``SLOTS``."""
    yield file_header()
    writer = ChunkWriter()
    for e in events:
        values = event_values(e)
        if not writer.add(int(e["record_id"]), int(e["ticks"]), values):
            yield writer.bytes()
            writer = ChunkWriter()
            if not writer.add(int(e["record_id"]), int(e["ticks"]), values):
                raise ValueError("an event does not fit into a chunk")
    if writer.ids:
        yield writer.bytes()
