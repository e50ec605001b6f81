"""Secrets, also inside nested encodings.

A worklist starts with the text itself. Each layer is scanned; its percent escapes, Unicode escapes,
base64 runs and compressed blobs (all their members, compressed again or not) are unwrapped into new
layers, until nothing new appears; bytes that are no UTF-8 are replaced and the rest is read. A base64 run is read
from each of its first four letters, since others may be glued to its start, and a compressed blob may
begin anywhere in decoded bytes, be they from base64, percent escapes or ``\\x`` escapes. A layer
that was seen before is not entered again, so cycles end. Every layer carries, for each of its
characters, the stretch of the original text that it came from, and findings are mapped back by it.

Kinds: ``assign``, ``access`` and ``hex`` follow the base patterns exactly; the method adds
``decoded_assign``, ``decoded_access`` and ``decoded_hex`` for findings in deeper layers.

Cases: null and empty texts have no spans; a null doc_id is kept; repeated rows give repeated rows; an
empty table gives an empty result; other columns are ignored. A compressed blob is inflated
and read whole in pieces of about ``BLOCK`` bytes; a piece grows only where no byte allows a cut (a line break, a comma, ...).
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, *(f"decoded_{k}" for k in BASE_KINDS))
BLOCK = 4 << 20
MIN_HEX = 24
#: Ten bytes, the least that a finding takes: 24 equal hex digits, compressed. Plain, the shortest is ``token=abcdef``.
MIN_BASE64 = 14

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_either = lambda s: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)
_ASSIGN = re.compile("(" + "|".join([*map(_either, _WORDS[:4]), _either("api") + "_?" + _either("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\u\{0*([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})")
#: Stretches that may be bytes in escapes, and their single bytes.
_PERCENT_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[!$&-;=@-Z_a-z~])+")
_PERCENT_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|.")
_SLASH_BYTES = re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\[abfnrtv0'\"\\]|[ -\[\]-~])+")
_SLASH_BYTE = re.compile(r"\\x([0-9A-Fa-f]{2})|\\(.)|.")
_SHORT_ESCAPES = dict(zip("abfnrtv0", b"\a\b\f\n\r\t\v\0", strict=True))
#: How compressed streams begin.
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_BASE64)
#: Bytes that occur in no finding and no encoding become 0, the others 1.
_CUTS = bytes(chr(i) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-\"' :%\\" for i in range(256))
_IN_BASE64 = bytes(120 if chr(i) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-" else 32 for i in range(256))


class Layer(NamedTuple):
    text: str
    starts: Sequence[int]  # of each character in the original
    ends: Sequence[int]
    place: tuple[int, int] | None = None  # of all characters alike, in place of starts and ends

    def original(self, start: int, end: int) -> tuple[int, int]:
        return self.place or (min(self.starts[start:end]), max(self.ends[start:end]))


def scan(text: str, longest: int) -> list[tuple[str, int, int]]:
    """Findings of one layer by the base patterns; ``longest``: see ``_long_run``."""
    found = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    if longest >= MIN_HEX:
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], BASE_KINDS.index(x[0])))


def _long_run(text: str) -> int:
    """``MIN_HEX`` where the text has a run of base64 letters that long, else ``MIN_BASE64`` where it has one of those, else 0."""
    letters = text.encode("utf-8", "replace").translate(_IN_BASE64)
    return next((n for n in (MIN_HEX, MIN_BASE64) if b"x" * n in letters), 0)


def _packed(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b" or head[:1] == b"\x78"


def _inflated(blocks: Iterable[bytes]) -> Iterator[bytes]:
    """All members of a compressed stream, in blocks; of a broken one, what comes before the break."""
    d = zlib.decompressobj(47)
    for data in blocks:
        while True:
            before = d.copy()
            try:
                out = d.decompress(data, BLOCK)
            except zlib.error:
                for i in range(len(data)):
                    try:
                        yield before.decompress(data[i : i + 1])
                    except zlib.error:
                        return
                return
            if out:
                yield out
            if d.eof:
                data, d = d.unused_data.lstrip(b"\0"), zlib.decompressobj(47)
            else:
                data = d.unconsumed_tail
                if len(out) == BLOCK:  # more may wait inside
                    continue
            if not data:
                break


def _layers(raw: bytes, place: tuple[int, int]) -> Iterator[Layer]:
    """``raw`` as text and, as long as it is compressed, what it inflates to, cut where no finding or encoding can reach across.

    Each turn inflates anew from ``raw``, so no inflated stream is ever held whole.
    """
    yield Layer(raw.decode("utf-8", "replace"), (), (), place)
    seen, mark, head, depth = set(), hashlib.blake2b(raw).digest(), raw[:2], 0
    while _packed(head) and mark not in seen:
        seen.add(mark)
        depth += 1
        stream: Iterable[bytes] = [raw]
        for _ in range(depth):
            stream = _inflated(stream)
        told, head, held, size = hashlib.blake2b(), b"", [], 0
        for out in stream:
            told.update(out)
            head = head if len(head) > 1 else head + out[:2]
            cut = out.translate(_CUTS).rfind(b"\0") + 1 if size + len(out) >= BLOCK else 0
            if cut:
                yield Layer(b"".join([*held, out[:cut]]).decode("utf-8", "replace"), (), (), place)
                held, size, out = [], 0, out[cut:]
            held.append(out)
            size += len(out)
        yield Layer(b"".join(held).decode("utf-8", "replace"), (), (), place)
        mark = told.digest()


def _characters(raw: bytes) -> Iterator[tuple[str, int]]:
    """Characters of ``raw`` and how many bytes each takes; a byte that fits nothing is one replacement character."""
    at = 0
    while at < len(raw):
        lead = raw[at]
        n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            c = raw[at : at + n].decode("utf-8")
        except UnicodeDecodeError:
            c, n = "\ufffd", 1
        yield c, n
        at += n


def _replaced(layer: Layer, pattern: re.Pattern, decoded: Callable[[re.Match], Iterable[tuple[str, int]]]) -> Layer | None:
    """The whole layer with every match of ``pattern`` decoded into characters, each taking so many letters of the match."""
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    at = 0
    for m in [*pattern.finditer(layer.text), None]:
        stop = m.start() if m else len(layer.text)
        out.append(layer.text[at:stop])
        if not layer.place:
            starts += layer.starts[at:stop]
            ends += layer.ends[at:stop]
        if m:
            at = m.start()
            for c, n in decoded(m):
                out.append(c)
                if not layer.place:
                    s, e = layer.original(at, at + n)
                    starts.append(s)
                    ends.append(e)
                at += n
    plain = "".join(out)
    return Layer(plain, starts, ends, layer.place) if plain != layer.text else None


def _mark(layer: Layer) -> bytes:
    return hashlib.blake2b(repr(layer.place or tuple(layer.starts[:1])).encode() + layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _inside(raw: bytes, place: Callable[[int], tuple[int, int]]) -> Iterator[Layer]:
    """What the compressed streams in ``raw`` hold; ``place`` gives the original stretch of what follows a byte."""
    for m in _PACKED.finditer(raw):
        layers = _layers(raw[m.start() :], place(m.start()))
        next(layers)  # the bytes as they are
        yield from layers


def _escaped_bytes(layer: Layer, stretches: re.Pattern, single: re.Pattern, mark: str) -> Iterator[Layer]:
    """Compressed streams whose bytes are written as escapes, which begin with ``mark``."""
    for m in stretches.finditer(layer.text):
        if mark not in m[0]:
            continue
        told = [*single.finditer(m[0])]
        raw = bytes(int(x[1], 16) if x[1] else _SHORT_ESCAPES.get(x[2], ord(x[2])) if x.re.groups > 1 and x[2] else ord(x[0]) for x in told)
        yield from _inside(raw, lambda at, m=m, told=told: layer.original(m.start() + told[at].start(), m.end()))


def _unescaped(m: re.Match) -> str:
    code = int(next(filter(None, m.groups())), 16)
    return chr(code) if code < 0x110000 else "\ufffd"


def _from_base64(layer: Layer, m: re.Match) -> Iterator[Layer]:
    letters = m[0].rstrip("=").replace("-", "+").replace("_", "/")
    for skip in range(min(4, len(letters))):
        body = letters[skip:]
        if len(body) % 4 == 1:  # a letter too many at the end
            body = body[:-1]
        try:
            raw = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        start, end = m.start() + skip, m.end()
        yield from _layers(raw, layer.original(start, end))
        if not _packed(raw[:2]):
            yield from _inside(raw, lambda at, start=start, end=end: layer.original(start + at // 3 * 4, end))


def _unwrapped(layer: Layer, longest: int) -> Iterator[Layer]:
    text = layer.text
    if "%" in text:
        found = _replaced(layer, _PERCENT, lambda m: ((c, 3 * n) for c, n in _characters(bytes.fromhex(m[0].replace("%", "")))))
        if found:
            yield found
            yield from _escaped_bytes(layer, _PERCENT_BYTES, _PERCENT_BYTE, "%")
    if "\\" in text:
        found = _replaced(layer, _ESCAPE, lambda m: [(_unescaped(m), len(m[0]))])
        if found:
            yield found
        if "\\x" in text:
            yield from _escaped_bytes(layer, _SLASH_BYTES, _SLASH_BYTE, "\\x")
    if longest:
        for m in _BASE64.finditer(text):
            yield from _from_base64(layer, m)


def spans(text: str) -> list[tuple[str, int, int]]:
    """All findings as (kind, start, end) in code points of ``text``, by start and then by kind, deeper layers last."""
    first = Layer(text, range(len(text)), range(1, len(text) + 1))
    run = _long_run(text)
    found = scan(text, run)
    if not run and "%" not in text and "\\" not in text:
        return found
    seen, held = {_mark(first)}, set(found)
    deeper: dict[tuple[str, int, int], None] = {}
    work = [_unwrapped(first, run)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        mark = _mark(layer)
        if not layer.text or mark in seen:
            continue
        seen.add(mark)
        run = _long_run(layer.text)
        for kind, s, e in scan(layer.text, run):
            place = layer.original(s, e)
            if (kind, *place) not in held:
                deeper[(f"decoded_{kind}", *place)] = None
        work.append(_unwrapped(layer, run))
    return sorted([*found, *deeper], key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and ``spans``, an array of (kind, start, end) in code points."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.documents(spark, sf_dir))
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *(of(k) for k in BASE_KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
