"""The decoder as table functions for SQL, over binary columns of chunks.

``decode_binxml(chunk)`` gives a row for each event of a chunk and stands behind LATERAL:
``SELECT f.name, e.record_id, e.xml FROM f, LATERAL decode_binxml(f.chunk) AS e``. Spark allows no Arrow function there, so its
rows cross as rows, in Arrow batches. ``decode_chunks(TABLE(SELECT file, chunk_index, chunk FROM f))`` takes and gives Arrow arrays and is
the faster form for whole tables. ``chunk_findings(chunk)`` gives what is wrong in a chunk. Null, and bytes that are no chunk, have no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from ..sources import container, ranges
from ..sources.binxml import CHUNK_SIZE

_EVENT = {n: t for n, t in ranges.EVENT_TYPES.items() if n in ("record_seq", "record_id", "ticks", "timestamp", "xml", *ranges.NAMES)}
_PLACE = {"file": pa.string(), "chunk_index": pa.int32()}


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return ", ".join(f"{n} {from_arrow_type(t).simpleString()}" for n, t in kinds.items())


def _whole(chunk: bytes | None) -> bool:
    return chunk is not None and len(chunk) >= CHUNK_SIZE and bytes(chunk[: len(container.CHUNK_MAGIC)]) == container.CHUNK_MAGIC


@udtf(returnType=_ddl(_EVENT), useArrow=True)
class DecodeBinxml:
    def eval(self, chunk: bytes) -> Iterator[tuple]:
        from decimal import Decimal

        if _whole(chunk):
            found = ranges.events(bytes(chunk[:CHUNK_SIZE]), list(_EVENT))
            found["ticks"] = [Decimal(t) for t in found["ticks"]]
            yield from zip(*(found[n] for n in _EVENT), strict=True)


@udtf(returnType="kind string, record_id decimal(20,0), message string", useArrow=True)
class ChunkFindings:
    def eval(self, chunk: bytes) -> Iterator[tuple]:
        from decimal import Decimal

        if _whole(chunk):
            d = container.decode_chunk(bytes(chunk[:CHUNK_SIZE]))
            for record, guid, offset in d["missing_refs"]:
                yield "missing template", Decimal(record), f"{guid} at 0x{offset:08x}"
            for record, message in d["parse_errors"]:
                yield "parse error", Decimal(record), message


@arrow_udtf(returnType=_ddl(_PLACE | _EVENT))
class DecodeChunks:
    def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
        for i, c in enumerate(table.column("chunk")):
            chunk = c.as_py()
            if _whole(chunk):
                found = ranges.events(chunk[:CHUNK_SIZE], list(_EVENT))
                n = len(found["record_seq"])
                place = {k: pa.array([table.column(k)[i].as_py()] * n, t) for k, t in _PLACE.items()}
                yield pa.table(place | {k: ranges.array(found[k], t) for k, t in _EVENT.items()})


FUNCTIONS = {"decode_binxml": DecodeBinxml, "chunk_findings": ChunkFindings, "decode_chunks": DecodeChunks}


def register(spark: SparkSession) -> list[str]:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
    return list(FUNCTIONS)
