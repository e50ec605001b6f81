"""Binary XML of one chunk to text.

Template bodies are compiled once per chunk into programs: literal text, slots for values and nested
instances. A record then costs one pass over its program. The compiler is a loop over tokens with its own
stack of open elements; a read outside the chunk becomes a failing step, so that it fails each record
that reaches it and no other.
"""

from __future__ import annotations

import functools
import itertools
import struct
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from ..functions import eventxml, values
from ..functions.values import OutOfChunk, unpack

CHUNK_SIZE = 65536
MAX_DEPTH = 200

# Tokens of the format and the flag for more data.
END, OPEN, CLOSE_START, CLOSE_EMPTY, CLOSE, VALUE, ATTRIBUTE, CDATA, CHAR_REF, ENTITY_REF, PI_TARGET, PI_DATA, TEMPLATE, SUBSTITUTION, OPTIONAL, FRAGMENT = range(16)
MORE = 0x40
#: Names of the tokens in diagnostics.
TOKEN_NAMES = ("EOF", "OpenStartElement", "CloseStartElement", "CloseEmptyElement", "EndElement", "Value", "Attribute", "CDATASection", "CharRef", "EntityRef", "PITarget", "PIData", "TemplateInstance", "NormalSubstitution", "OptionalSubstitution", "FragmentHeader")
_STOPS = frozenset((END, CLOSE_START, CLOSE_EMPTY, CLOSE, ATTRIBUTE))


def token_name(byte: int) -> str:
    base = byte & ~MORE
    return (TOKEN_NAMES[base] if base < 16 else f"Unknown_0x{byte:02X}") + ("+MoreData" if byte & MORE else "")


#: A value: its place, its size (0 where it does not fit) and its type code.
Value = tuple[int, int, int]


@functools.cache
def _descriptors(count: int) -> struct.Struct:
    """Size and type code of so many values."""
    return struct.Struct("<" + "HBx" * count)


class Instance(NamedTuple):
    """A use of a template: the offset of its definition and the values for its slots."""

    offset: int
    guid: str
    size: int
    known: bool  # there was a definition to read
    values: Sequence[Value]
    kinds: tuple[int, ...]


class Failure(NamedTuple):
    message: str


class TooDeep(Exception):
    def __init__(self) -> None:
        super().__init__("Maximum call stack size exceeded")


Step = str | int | Instance | Failure


@dataclass
class Definition:
    offset: int
    guid: str
    size: int
    first_record: int


@dataclass
class Audit:
    """What decoding a chunk has met."""

    definitions: dict[int, Definition] = field(default_factory=dict)
    references: int = 0
    missing: list[tuple[int, str, int]] = field(default_factory=list)
    errors: list[tuple[int, str]] = field(default_factory=list)


def _joined(program: list[Step]) -> list[Step]:
    """The program with neighbouring literal texts as one."""
    out: list[Step] = []
    for literal, steps in itertools.groupby(program, lambda s: type(s) is str):
        out += ["".join(steps)] if literal else steps
    return out


class ChunkXml:
    """Decoder of the binary XML of one 64 KiB chunk; all positions are offsets in the chunk."""

    def __init__(self, chunk: bytes) -> None:
        self.chunk = chunk
        self.audit = Audit()
        self.record = 0
        self._names: dict[int, str] = {}
        self._programs: dict[tuple[int, int], list[Step]] = {}
        self._outlines: dict[tuple[int, int, tuple[int, ...]], eventxml.Outline | None] = {}
        self._top: tuple[Instance, dict[int, str], int] | None = None  # the record's outermost template, its slots' texts and its length

    # definitions -----------------------------------------------------------------------------------

    def preload(self, heads: tuple[int, ...]) -> None:
        """Follow the chains of definitions of the chunk's table; a definition that is known ends its chain."""
        for at in heads:
            while at and at not in self.audit.definitions and at + 24 <= CHUNK_SIZE:
                self._define(at, values.guid_text(self.chunk[at + 4 : at + 20]), unpack("<I", self.chunk, at + 20), 0)
                at = unpack("<I", self.chunk, at)

    def _define(self, at: int, guid: str, size: int, record: int) -> None:
        self.audit.definitions.setdefault(at, Definition(at, guid, size, record))

    # reading -----------------------------------------------------------------------------------------

    def _name(self, at: int) -> str:
        if at not in self._names:
            n = unpack("<H", self.chunk, at + 6)
            if at + 8 + 2 * n > len(self.chunk):
                raise OutOfChunk
            self._names[at] = values.utf16(self.chunk[at + 8 : at + 8 + 2 * n])
        return self._names[at]

    def _named(self, at: int) -> tuple[str, int]:
        """The name that the offset at ``at`` refers to, and the position after it and any inline definition."""
        where = unpack("<I", self.chunk, at)
        after = at + 4
        if where == after:
            after += 10 + 2 * unpack("<H", self.chunk, after + 6)
        return self._name(where), after

    def _counted(self, at: int) -> tuple[str, int]:
        n = unpack("<H", self.chunk, at)
        if at + 2 + 2 * n > len(self.chunk):
            raise OutOfChunk
        return values.utf16(self.chunk[at + 2 : at + 2 + 2 * n]), at + 2 + 2 * n

    def _instance(self, at: int, end: int) -> tuple[Instance, int]:
        offset = unpack("<I", self.chunk, at + 6)
        at += 10
        known, guid, size = True, "", 0
        if offset == at:
            guid, size = values.guid_text(self.chunk[at + 4 : at + 20].ljust(16, b"\0")), unpack("<I", self.chunk, at + 20)
            at += 24 + size
        elif held := self.audit.definitions.get(offset):
            guid, size = held.guid, held.size
        elif offset + 24 <= CHUNK_SIZE:
            guid, size = values.guid_text(self.chunk[offset + 4 : offset + 20]), unpack("<I", self.chunk, offset + 20)
        else:
            known = False
        count = unpack("<I", self.chunk, at)
        descriptor = at + 4
        at = descriptor + 4 * count
        if count and at - 2 > len(self.chunk):
            self.audit.references += 1  # it counts before its values are read
            if known:
                self._define(offset, guid, size, self.record)
            raise OutOfChunk
        found = []
        whole = at <= end and at <= len(self.chunk)
        told = _descriptors(count).unpack_from(self.chunk, descriptor) if whole else tuple(x for d in range(descriptor, descriptor + 4 * count, 4) for x in (unpack("<H", self.chunk, d), self.chunk[d + 2] if d + 2 < end else 0))
        for n, kind in zip(told[::2], told[1::2], strict=True):
            found.append((at, n if at + n <= end else 0, kind))
            at += n
        return Instance(offset, guid, size, known, found, told[1::2]), at

    # compiling ---------------------------------------------------------------------------------------

    def compile(self, start: int, at: int, end: int, first: bool = False) -> tuple[list[Step], int]:
        """Program of the content from ``at`` up to ``end``, of a range that begins at ``start``.

        With ``first`` only one element is compiled, which is at ``at``.
        """
        out: list[Step] = []
        try:
            at = self._content(out, start, at, end, first)
        except OutOfChunk as e:
            out.append(Failure(str(e)))
            at = end
        return out, at

    def _content(self, out: list[Step], start: int, at: int, end: int, first: bool) -> int:
        chunk = self.chunk
        open_: list[tuple[str, int | None]] = []  # element, and the end of its attributes while in one
        while True:
            token = chunk[at] if at < end else END
            base = token & ~MORE
            if base in _STOPS:
                if not open_:
                    return at
                name, attributes_end = open_.pop()
                if attributes_end is not None:
                    out.append('"')
                    at = self._start_tag(out, open_, name, attributes_end, at, end)
                else:
                    at += at < end and chunk[at] == CLOSE
                    out.append(f"</{name}>")
            elif base == OPEN:
                name, after = self._named(at + 7)
                out.append(f"<{name}")
                attributes_end = after
                if token & MORE:
                    attributes_end = after + 4 + unpack("<I", chunk, after)
                    after += 4
                at = self._start_tag(out, open_, name, attributes_end, after, end)
            elif base == VALUE:
                text, at = self._counted(at + 2)
                out.append(values.escape(text))
            elif base in (SUBSTITUTION, OPTIONAL):
                out.append(unpack("<H", chunk, at + 1))
                at += 4
            elif base == CHAR_REF:
                out.append(f"&#{unpack('<H', chunk, at + 1)};")
                at += 3
            elif base == ENTITY_REF:
                out.append(f"&{self._name(unpack('<I', chunk, at + 1))};")
                at += 5
            elif base == CDATA:
                text, at = self._counted(at + 1)
                out.append(f"<![CDATA[{text}]]>")
            elif base == TEMPLATE:
                step, at = self._instance(at, end)
                out.append(step)
            elif base == FRAGMENT:
                at = self._fragment(out, start, at, end)
            else:
                out.append(f"<!-- UNEXPECTED token 0x{token:02X} ({token_name(token)}) at {at - start} -->")
                at += 1
            if first and not open_:
                return at

    def _start_tag(self, out: list[Step], open_: list, name: str, attributes_end: int, at: int, end: int) -> int:
        """From inside a start tag to the next attribute's value, or past the tag."""
        token = self.chunk[at] if at < end else -1
        if at < attributes_end and token >= 0 and token & ~MORE == ATTRIBUTE:
            attribute, at = self._named(at + 1)
            out.append(f' {attribute}="')
            open_.append((name, attributes_end))
        elif token in (-1, CLOSE_EMPTY):
            out.append("/>")
            at += token >= 0
        elif token == CLOSE_START:
            out.append(">")
            open_.append((name, None))
            at += 1
        else:
            out.append(f"><!-- BAD close 0x{token:02X} --></{name}>")
        return at

    def _fragment(self, out: list[Step], start: int, at: int, end: int) -> int:
        if at + 4 > end:
            out.append(f"<!-- TRUNCATED fragment at {at - start} -->")
            return end if at >= end else max(at + 1, end)  # nothing but the header is left
        at += 4
        if at >= end:
            out.append("<!-- TRUNCATED after fragment header -->")
            return at
        base = self.chunk[at] & ~MORE
        if base == TEMPLATE:
            step, at = self._instance(at, end)
            out.append(step)
        elif base == OPEN:
            steps, at = self.compile(start, at, end, first=True)
            out.extend("" if isinstance(s, int) else s for s in steps)  # no values to fill in here
        else:
            out.append(f"<!-- UNEXPECTED post-fragment 0x{self.chunk[at]:02X} at {at - start} -->")
        return at

    # running -----------------------------------------------------------------------------------------

    def document(self, start: int, end: int, depth: int = 0) -> str:
        """Text of the document in a range of the chunk."""
        chunk, at, out = self.chunk, start, []
        while at < end and (base := chunk[at] & ~MORE) != END:
            if base == FRAGMENT:
                steps: list[Step] = []
                before = at
                at = self._fragment(steps, start, at, end)
                out.append(self._run(steps, (), depth))
                if at == before:
                    break
            elif base == PI_TARGET:
                name = self._name(unpack("<I", chunk, at + 1))
                at += 5
                data = ""
                if at < end and chunk[at] == PI_DATA:
                    data, at = self._counted(at + 1)
                    data = f" {data}"
                out.append(f"<?{name}{data}?>")
            else:
                out.append(f"<!-- UNEXPECTED doc token 0x{chunk[at]:02X} ({token_name(chunk[at])}) at {at - start} -->")
                break
        return "".join(out)

    def _run(self, program: list[Step], given: Sequence[Value], depth: int, texts: dict[int, str] | None = None) -> str:
        if depth > MAX_DEPTH:
            raise TooDeep
        chunk, texts, out = self.chunk, {} if texts is None else texts, []
        for step in program:
            kind = type(step)
            if kind is str:
                out.append(step)
            elif kind is int:
                if step in texts:
                    out.append(texts[step])
                elif step < len(given):
                    at, size, code = given[step]
                    if code == values.STRING:
                        text = values.string(chunk, at, size)
                    else:
                        text = self.document(at, at + size, depth + 1) if code == values.BINXML and size else values.render(chunk, at, size, code)
                    texts[step] = text
                    out.append(text)
            elif kind is Instance:
                out.append(self._expand(step, depth))
            else:
                raise ValueError(step.message)
        return "".join(out)

    def _expand(self, use: Instance, depth: int) -> str:
        if use.known:
            self._define(use.offset, use.guid, use.size, self.record)
        self.audit.references += 1
        if not use.size or use.offset + 24 + use.size > CHUNK_SIZE:
            self.audit.missing.append((self.record, use.guid or "(unknown)", use.offset))
            return f"<!-- missing template def at 0x{use.offset:08x} -->"
        key = (use.offset, use.size)
        if key not in self._programs:
            body = use.offset + 24
            skip = 4 if use.size >= 4 and self.chunk[body] == FRAGMENT else 0
            self._programs[key] = _joined(self.compile(body, body + skip, body + use.size)[0])
        if depth:
            return self._run(self._programs[key], use.values, depth + 1)
        texts: dict[int, str] = {}
        text = self._run(self._programs[key], use.values, 1, texts)
        self._top = use, texts, len(text)
        return text

    def _outline(self, use: Instance) -> eventxml.Outline | None:
        """Of events of this template with values of these types; None where they may hold markup of their own."""
        key = (use.offset, use.size, use.kinds)
        if key not in self._outlines:
            program = self._programs[key[:2]]
            plain = values.PLAIN.issuperset(use.kinds) and all(type(s) is int or (type(s) is str and "\0" not in s) for s in program)
            self._outlines[key] = eventxml.Outline("".join(s if type(s) is str else f"\0{s}\0" for s in program)) if plain else None
        return self._outlines[key]

    def fields(self, text: str) -> list[str | int]:
        """Columns of the event that ``event`` has just given as ``text``."""
        if self._top and self._top[2] == len(text) and (outline := self._outline(self._top[0])):
            return outline.values(self._top[1], text)
        return eventxml.event_values(text)

    def event(self, record: int, start: int, end: int) -> tuple[str, str | None]:
        """Text of a record's document, and what went wrong."""
        self.record, self._top = record, None
        try:
            return self.document(start, end), None
        except (OutOfChunk, TooDeep, ValueError, RecursionError) as e:
            message = "Maximum call stack size exceeded" if isinstance(e, RecursionError) else str(e)
            self.audit.errors.append((record, message))
            return f"<!-- BinXml parse error: {message} -->\n", message
