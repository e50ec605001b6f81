"""Substring dedup over words by prefix-partitioned suffix trees.

Suffixes are split by a variable-length prefix: by the anchor k-gram that all windows of a context
share, or, where that leaves a group over its budget, by the whole window. A task builds the trees of
its groups one after the other (``SuffixTree``): suffixes in order, the depth at which neighbours
part, and from them the internal nodes. A node at depth ``length`` or more is a repeat; its earliest
leaf stays, windows at the others go. See ``repeats`` for the candidate search and the hot groups.

Cases: null or blank texts have no words; texts of fewer than ``length`` words keep all; a null doc_id
counts as the largest; rows of equal doc_id tie at equal starts and neither goes for the other; repeated
rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, repeats

WINDOW_WORDS = 20
ANCHOR_WORDS = 8
CHUNK_UNITS = 250_000


class SuffixTree:
    """Suffixes of ``units`` from ``starts``, cut at ``depth`` units, as a tree in the form of order and depths.

    ``order`` lists the suffixes as leaves from left to right, ``common[i]`` is the string depth of the
    lowest node above leaves i-1 and i.
    """

    def __init__(self, units: np.ndarray, starts: np.ndarray, depth: int) -> None:
        strings = units[starts[:, None] + np.arange(depth)]
        rank = np.zeros(len(starts), dtype=np.int64)
        order = np.arange(len(starts))
        for d in range(depth):  # refine level by level; only leaves below branching nodes are sorted again
            order = self._refine(order, rank, strings[:, d])
            parts = np.empty(len(order), dtype=bool)
            parts[:1] = False
            parts[1:] = (rank[order[1:]] != rank[order[:-1]]) | (strings[order[1:], d] != strings[order[:-1], d])
            rank[order] = np.cumsum(parts)
        self.order = order
        same = strings[order[1:]] == strings[order[:-1]]
        self.common = np.concatenate(([0], np.where(same.all(axis=1), depth, same.argmin(axis=1)))).astype(np.int64)

    @staticmethod
    def _refine(order: np.ndarray, rank: np.ndarray, level: np.ndarray) -> np.ndarray:
        r = rank[order]
        shared = np.zeros(len(r), dtype=bool)
        shared[1:] = r[1:] == r[:-1]
        shared[:-1] |= shared[1:].copy()
        some = np.flatnonzero(shared)
        if len(some):
            order = order.copy()
            members = order[some]
            order[some] = members[np.lexsort((level[members], rank[members]))]
        return order

    def deep_nodes(self, depth: int) -> np.ndarray:
        """For each suffix, the number of its highest node at ``depth`` or deeper (a leaf counts as its own)."""
        node = np.empty(len(self.order), dtype=np.int64)
        node[self.order] = np.cumsum(self.common < depth) - 1
        return node


def later_windows(group: repeats.Contested, length: int) -> np.ndarray:
    starts, doc, start = repeats.places(group)
    node = SuffixTree(group.units, starts, length).deep_nodes(length)
    first = np.full(int(node.max()) + 1 if len(node) else 0, len(node), dtype=np.int64)
    np.minimum.at(first, node, np.arange(len(node)))  # windows are in order of place
    head = first[node]
    return (doc != doc[head]) | (start != start[head])


_RESULT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string()}


def _finish(texts: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, body) to the result, with the kept text or without; kept words are copied from the text's own bytes."""
    kinds = dict(list(_RESULT.items())[: None if texts else -1])
    for b in batches:
        out: list[tuple] = []
        ids = b.column(0).to_pylist()
        bodies = b.column(2)
        for i, j, data, offsets in common.text_slices(b.column(1)):
            ws, we, first = common.word_bounds(data, offsets)
            raw = data.tobytes()
            keep = np.ones(len(ws), dtype=bool)
            for d in range(i, j):
                if (body := bodies[d].as_py()) is not None:
                    for s, e in np.frombuffer(body, dtype=repeats.SPAN)[["start", "end"]].tolist():
                        keep[first[d - i] + s : first[d - i] + e] = False
            sums = np.concatenate(([0], np.cumsum(~keep)))
            starts, ends = ws.tolist(), we.tolist()
            for d in range(i, j):
                a, z = int(first[d - i]), int(first[d - i + 1])
                gone = int(sums[z] - sums[a])
                words = [raw[starts[w] : ends[w]] for w in range(a, z)] if not gone else [raw[starts[w] : ends[w]] for w in (np.flatnonzero(keep[a:z]) + a).tolist()]
                text = b" ".join(words)
                out.append((ids[d], z - a, gone, hashlib.sha256(text).hexdigest(), *([text.decode()] * texts)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))


def dedup_words(docs: DataFrame, *, window: int = WINDOW_WORDS, anchor: int = ANCHOR_WORDS, texts: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept_text."""
    found = repeats.repeated_spans(docs, repeats.word_units, np.dtype("<u8"), later_windows, length=window, k=anchor, chunk_units=CHUNK_UNITS)
    return found.select("doc_id", "text", "body").mapInArrow(functools.partial(_finish, texts), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * texts)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(common.documents(spark, sf_dir), texts=False)
