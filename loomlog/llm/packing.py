"""Bounded-space online packing of token documents into windows of a fixed length.

A task keeps at most ``open_windows`` unfinished windows. A piece goes to the open window that it
fills best. Where none fits, the fullest window takes the head of the piece, is emitted full, and the
tail is placed again. At the end of the partition the open windows top each other up, so one partial
window a partition is left; those are merged, a bounded number at a time, into shared windows.

Cases: a null or empty text is one document with only the end id. A null doc_id is kept. Repeated rows
are separate documents. A text longer than a window is cut. An empty table gives an empty result.
Windows are padded to ``window`` tokens, save where what they hold is a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 1024
OPEN_WINDOWS = 16
MERGE_GROUP = 256
END_ID = 0

#: Texts with only these characters are split alike by both tokenizer libraries, whatever their Unicode version.
_PLAIN = r"[\x00-ͯΆ-ԯ؀-ۿḀ-῿‐-‧‰-⁞₠-₿ぁ-ヿ一-龥]*"
_SPECIAL = "<|endoftext|>"

_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("open", pa.bool_())])
RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class TokenIds:
    """Ids of a byte-level BPE vocabulary file, as the ``tokenizers`` library gives them.

    The same vocabulary is read by the faster ``tiktoken`` for texts of plain characters; any text
    where the libraries could differ (special-token strings, characters that newer Unicode tables
    class anew, inputs that it refuses) goes to ``tokenizers``.
    """

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None) -> None:
        import base64
        import re

        import public_tokenizers
        import tiktoken

        self.path = json_path or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = re.compile(_PLAIN)
        self.exact = None

    def slow(self, text: str) -> np.ndarray:
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.path)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if _SPECIAL in text or self.plain.fullmatch(text) is None or (len(text) > 1 << 20):
            return self.slow(text)
        return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)


class Packer:
    """Open windows of one task. ``emit`` gets finished rows, in the order of ``_PIECES``."""

    def __init__(self, first_sequence: int, window: int, open_windows: int) -> None:
        self.next = first_sequence
        self.window, self.limit = window, open_windows
        self.open: list[list] = []  # [fill, pieces]
        self.rows: list[tuple] = []

    def _close(self, w: list, still_open: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, total in w[1]:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids), total, self.next, offset, still_open))
            offset += len(ids)
        self.next += 1

    def place(self, doc_id: int | None, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids):
            if len(ids) >= self.window:
                self._close([self.window, [(doc_id, start, ids[: self.window], total)]])
                ids, start = ids[self.window :], start + self.window
                continue
            fits = [w for w in self.open if w[0] + len(ids) <= self.window]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.limit:
                best = [0, []]
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w[0])
            k = min(len(ids), self.window - best[0])
            best[1].append((doc_id, start, ids[:k], total))
            best[0] += k
            if best[0] == self.window:
                self.open.remove(best)
                self._close(best)
            ids, start = ids[k:], start + k

    def finish(self) -> None:
        rest, self.limit = sorted(self.open, key=lambda w: -w[0]), 1
        self.open = rest[:1]
        for w in rest[1:]:
            for piece in w[1]:
                self.place(*piece)
        for w in self.open:
            self._close(w, still_open=True)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECES.types, strict=True)], schema=_PIECES)


def pack(docs: DataFrame, *, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, tokenizer_json: str | None = None, tokenizer_ranks: str | None = None) -> DataFrame:
    """One row for each piece of each document of ``docs`` (doc_id, text): see the module for the rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = TokenIds(tokenizer_json, tokenizer_ranks)
        packer = Packer(TaskContext.get().partitionId() << 32, window, open_windows)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(ids_of(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                packer.place(doc_id, 0, ids, len(ids))
                if len(packer.rows) > 20_000:
                    yield packer.batch()
        packer.finish()
        if packer.rows:
            yield packer.batch()

    kinds = ", ".join(f"`{n}` {'boolean' if n == 'open' else 'bigint'}" for n in _PIECES.names)
    pieces = common.checkpointed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kinds))

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        """Best fit decreasing over at most ``MERGE_GROUP`` partial windows."""
        ids, fills = table["sequence_id"].to_pylist(), table["fill"].to_pylist()
        open_: list[list[int]] = []
        out = []
        for fill, sequence in sorted(zip(fills, ids, strict=True), key=lambda x: (-x[0], x[1])):
            home = max((w for w in open_ if w[1] + fill <= window), key=lambda w: w[1], default=None)
            if home is None:
                home = [sequence, 0]
                open_.append(home)
            out.append((sequence, home[0], home[1]))
            home[1] += fill
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("sequence_id", "home", "shift"))})

    left = pieces.filter("open")
    fills = left.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    homes = fills.withColumn("part", F.shiftright("sequence_id", 32).cast("int")).groupBy(F.expr(f"part div {MERGE_GROUP}")).applyInArrow(merge, "sequence_id bigint, home bigint, shift bigint")
    moved = left.join(homes, "sequence_id").select(*RESULT[:5], F.col("home").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return pieces.filter("not open").select(*RESULT).unionByName(moved)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
