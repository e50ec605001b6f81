"""Substring dedup over bytes with a run-length index.

The contested contexts of a group (see ``repeats``) become one text with separators. ``RunLengthIndex``
builds its Burrows-Wheeler transform, keeps the runs and the text positions sampled at run ends, and
streams matching statistics from them: at the head of a run the longest match with the preceding suffix
is measured on the text, and from one sampled position to the next match and partner move along together,
the length less by one each step. Matches of ``length`` bytes link equal windows; the earliest stays.

Cases: null and empty texts have no bytes; texts shorter than ``length`` keep all; a null doc_id counts
as the largest; rows of equal doc_id tie at equal starts and neither goes for the other; repeated rows
give repeated results; an empty table gives an empty result; other columns are ignored. Removal works on
bytes, so what is kept need not be UTF-8.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, repeats

WINDOW_BYTES = 100
ANCHOR_BYTES = 32
CHUNK_UNITS = 1_000_000
SEPARATOR = 255  # no byte of UTF-8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of bytes by prefix doubling; only suffixes that still tie are sorted again.

    The end of the text counts as separators without end, which is larger than all that a separator starts.
    """
    n = len(text)
    padded = np.concatenate((text, np.full(8, SEPARATOR, dtype=np.uint8))).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    opens = np.ones(n, dtype=bool)
    opens[1:] = key[1:] != key[:-1]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = n + 1
    rank[order] = np.flatnonzero(opens)[np.cumsum(opens) - 1] + 1
    slots, h = np.arange(n), 8
    while True:
        tied = np.zeros(len(slots), dtype=bool)
        r = rank[order[slots]]
        tied[1:] = r[1:] == r[:-1]
        tied[:-1] |= tied[1:].copy()
        slots = slots[tied]
        if not len(slots):
            return order
        at = order[slots]
        both = (rank[at] << 32) | rank[np.minimum(at + h, n)]
        again = np.argsort(both)
        both, at = both[again], at[again]
        order[slots] = at
        opens = np.ones(len(at), dtype=bool)
        opens[1:] = both[1:] != both[:-1]
        rank[at] = slots[np.flatnonzero(opens)[np.cumsum(opens) - 1]] + 1
        h *= 2


class RunLengthIndex:
    """Runs of the Burrows-Wheeler transform of ``text``, with the text positions at their first and last rows."""

    def __init__(self, text: np.ndarray) -> None:
        self.text = text
        order = suffix_order(text)
        last = text[order - 1].astype(np.int16)
        last[order == 0] = -1  # nothing stands before the whole text: a run of its own
        heads = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))
        self.symbols = last[heads]
        self.lengths = np.diff(np.append(heads, len(text)))
        self.first = order[heads]
        self.last = order[np.append(heads[1:], len(text)) - 1]

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text position the length of its match with the suffix before it in order, and where that is."""
        n = len(self.text)
        here, there = self.first[1:], self.last[:-1]
        order = np.argsort(here)
        here, there = here[order], there[order]
        long = self._match(here, there)
        known = np.searchsorted(here, np.arange(n), "right") - 1
        if not len(here):
            return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        step = np.arange(n) - here[np.maximum(known, 0)]
        length = np.where(known >= 0, long[np.maximum(known, 0)] - step, 0)  # only the least suffix of all can come before the first sample
        return np.maximum(length, 0), np.where(known >= 0, there[np.maximum(known, 0)] + step, 0)

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = len(self.text)
        words = np.concatenate((self.text, np.zeros(8, dtype=np.uint8)))
        view = np.lib.stride_tricks.as_strided(words, (n + 1, 8), (1, 1))
        length = np.zeros(len(a), dtype=np.int64)
        going = np.arange(len(a))
        while len(going):
            x, y = a[going] + length[going], b[going] + length[going]
            inside = (x < n) & (y < n)
            going, x, y = going[inside], x[inside], y[inside]
            same = view[x] == view[y]
            whole = same.all(axis=1)
            length[going] += np.where(whole, 8, same.argmin(axis=1))
            going = going[whole]
        return np.minimum(length, n - np.maximum(a, b))


def later_windows(group: repeats.Contested, length: int) -> np.ndarray:
    at, doc, start = repeats.places(group)
    sizes = group.head["windows"].astype(np.int64) + (length - 1)
    number = np.arange(len(sizes))
    text = np.full(int(sizes.sum()) + len(sizes), SEPARATOR, dtype=np.uint8)
    text[np.arange(len(group.units)) + np.repeat(number, sizes)] = group.units
    at = at + np.repeat(number, group.head["windows"])
    long, there = RunLengthIndex(text).matching_statistics()
    window = np.full(len(text), -1, dtype=np.int64)
    window[at] = np.arange(len(at))
    partner = np.arange(len(at))
    matched = long[at] >= length
    partner[matched] = window[there[at[matched]]]
    while True:  # follow the partners to the first suffix of each class
        further = partner[partner]
        if np.array_equal(further, partner):
            break
        partner = further
    first = np.full(len(at), len(at), dtype=np.int64)
    np.minimum.at(first, partner, np.arange(len(at)))  # windows are in order of place
    head = first[partner]
    return (doc != doc[head]) | (start != start[head])


_RESULT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}


def _finish(texts: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, body) to the result, with the kept bytes or without."""
    kinds = dict(list(_RESULT.items())[: None if texts else -1])
    for b in batches:
        out: list[tuple] = []
        for doc_id, text, body in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2), strict=True):
            raw, parts, at, spans = text.as_py() or b"", [], 0, []
            if body.as_py() is not None:
                spans = repeats.merged(np.frombuffer(body.as_py(), dtype=repeats.SPAN))[["start", "end"]].tolist()
            for s, e in spans:
                parts.append(raw[at:s])
                at = e
            kept = b"".join((*parts, raw[at:]))
            out.append((doc_id, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept)[: len(kinds)])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))


def dedup_bytes(docs: DataFrame, *, window: int = WINDOW_BYTES, anchor: int = ANCHOR_BYTES, texts: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, kept."""
    found = repeats.repeated_spans(docs, repeats.byte_units, np.dtype("u1"), later_windows, length=window, k=anchor, chunk_units=CHUNK_UNITS)
    return found.select("doc_id", "text", "body").mapInArrow(functools.partial(_finish, texts), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * texts)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(common.documents(spark, sf_dir), texts=False)
