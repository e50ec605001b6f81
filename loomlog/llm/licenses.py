"""Licence scans by a trained paragraph classifier.

Paragraphs (lines, and stretches across line breaks up to a blank line; long ones overlap) are scored by a logistic regression over hashed
word one- and two-grams, one class for each licence family, one for unknown licences and one for everything else. It is trained
here on varied templates, on notices of other licences and of made-up ones as examples of the unknown, and on paragraphs
of the corpus as counterexamples, from a bounded sample: ``PARAGRAPHS_EACH`` lines, of ``PARAGRAPH_CHARACTERS`` at most, of
``TRAINING_DOCUMENTS`` different documents. A temperature and a shift calibrate probabilities at a licence share of ``LICENCE_SHARE``; they are fitted on notices that a first
training has not seen in any variant, whole licences among them, which should come out as unknown.
Predictions are confirmed by comparing the paragraph with the templates of its family: the share of a
template's words found in order, and the ``NAMES`` that tell the family from its likes. A paragraph that is likely a licence
but is not confirmed is ``unknown`` if it shares ``SHARED_PAIRS`` different word pairs with any notice of the tables below.

Cases: null and empty texts have no findings; a null doc_id is kept; repeated rows give repeated findings;
an empty table trains on templates and built-in sentences only and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TRAINING_DOCUMENTS = 400
PARAGRAPHS_EACH = 8
PARAGRAPH_CHARACTERS = 400
BUCKETS = 1 << 15
STRETCH = 48
STEP = 24
LIKELY = 0.5
LICENCE_SHARE = 0.05  # of paragraphs; training weighs classes alike, predictions take this prior
CONFIRM = 0.6
SHARED_PAIRS = 2
VARIANTS = 60

#: Families and typical notices of each.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    "AGPL": ("This program is licensed under the GNU Affero General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    "BSD": ("Licensed under the BSD 3-Clause License.", "Released under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "MPL-2.0": ("Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0": ("Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
}
_OTHER = ("All rights reserved by their owners.", "The licence plate of the car was under the seat.", "She was released under the old bridge in version two of the story.", "The public library is general and free.", "A driving license is required by law.", "The university granted permission to any person.", "This work was the work of years.", "Copyright is a matter of law, and the court has not decided.", "He was licensed to fish in the lake.", "The apache helicopters and the gnu herds were seen.", "They distribute copies to the public for a fee.", "Version 2.0 of the program was faster.", "He was licensed to practise medicine in two states.", "All seats were reserved for the guests of the king.", "Permission to enter the building is granted by the owner.", "The software was released in the spring of that year.", "The terms of the contract were public and general.", "She published a paper on copyright and the law of the sea.", "You can use this road for free at any time of the day.", "The author of the work is not known.", "Version two of the plan was modified without notice.", "A fishing licence costs more than a book.", "The foundation was dedicated to the public good.", "Any person may obtain a copy of the map at the office.", "The source of the river is free of ice.", "They distribute food and warm clothes to the poor.", "The commons lay behind the mill.", "The warranty of the car had expired.", "The prisoners were released under guard.", "In no event would he leave the house.", "The use of the hall is subject to the rules of the club.", "Work on the bridge was made available to the public.")
FAMILIES = tuple(TEMPLATES)
UNKNOWN = len(FAMILIES)

#: Words one of which a notice of the family holds in this order, and words that tell of a sibling instead.
NAMES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "MIT": (("mit", "free of charge to any person", "person obtaining a copy"), ()),
    "Apache-2.0": (("apache",), ("apache license version 1.0", "apache license version 1.1", "apache 1.0", "apache 1.1")),
    "GPL": (("gnu general public", "gpl", "gplv2", "gplv3"), ()),
    "LGPL": (("lesser general public", "library general public", "lgpl", "lgplv2", "lgplv3"), ()),
    "AGPL": (("affero general public", "affero gpl", "agpl", "agplv3"), ()),
    "BSD": (("bsd", "source and binary forms"), ()),
    "MPL-2.0": (("mozilla public", "mpl"), ("public license version 1.0", "public license version 1.1", "mpl 1.0", "mpl 1.1")),
    "CC-BY": (("cc by", "commons attribution"), ("by sa", "by nc", "by nd", "sharealike", "share alike", "noncommercial", "non commercial", "noderivatives", "noderivs")),
    "CC-BY-SA": (("by sa", "sharealike", "share alike"), ("nc", "noncommercial", "non commercial")),
    "CC-BY-NC": (("by nc", "noncommercial", "non commercial"), ("sa", "nd", "sharealike", "share alike", "noderivatives", "noderivs")),
    "CC0": (("cc0", "waived all copyright"), ()),
    "ISC": (("isc", "with or without fee"), ()),
    "Unlicense": (("unlicense", "unencumbered"), ()),
}

#: Notices of licences outside the families, from which the classifier learns what unknown ones look like.
OTHER_LICENCES: dict[str, tuple[str, ...]] = {
    "CDDL": ("Licensed under the Common Development and Distribution License, Version 1.0.", "The contents of this file are subject to the terms of the Common Development and Distribution License. You may not use this file except in compliance with the License."),
    "PostgreSQL": ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted",),
    "HPND": ("This software is provided \"as is\" without express or implied warranty of any kind.", "In no event shall the authors be liable for any damages arising from the use of this software."),
    "OFL": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.",),
    "Ms-PL": ("This source code is subject to the Microsoft Public License.", "SPDX-License-Identifier: MS-PL"),
    "OSL": ("Licensed under the Open Software License version 3.0.", "This program and the accompanying materials are made available under the terms of the Open Software License"),
    "Python": ("Licensed to the foundation under a contributor agreement.", "Released under the Python Software Foundation License, version 2."),
    "Ruby": ("This is free software; you can redistribute it and/or modify it under the terms of the Ruby License.",),
    "WTFPL": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document",),
    "Proprietary": ("This software is proprietary; use is subject to the license agreement.", "Use of this source code is governed by a license that can be found in the LICENSE file."),
}
#: Frames of made-up licences; a name and a version go in.
_FRAMES = ("Licensed under the {} License, Version {}.", "Released under the {} License.", "This work is licensed under the {} Public License {}.", "SPDX-License-Identifier: {}-{}", "You may use this file under the terms of the {} Software License, Version {}.", "Distributed under the {} Licence, version {}; see the file LICENSE for details.", "This program is made available under the terms of the {} Public License {}", "Licensed under the {}, Version {} or later versions (the \"Licence\"); you may not use this work except in compliance with the Licence.", "Use of this file is governed by the {} Licence, version {}, or any later version approved by its publisher.")

_WORD = re.compile(r"[a-z0-9.+-]+")
SCHEMA = "doc_id bigint, family string, predicted string, start_byte bigint, end_byte bigint, probability double, similarity double"


def words_of(text: str) -> list[str]:
    return [w.strip(".-+") for w in _WORD.findall(text.lower()) if w.strip(".-+")]


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of lower-cased words, their first bytes and ends; trailing full stops and commas are not part of a word."""
    lower = common.LOWER[data]
    ws, we, _ = common.word_bounds(lower, offsets)
    stops = np.isin(lower, np.frombuffer(b".,;:()\"", dtype=np.uint8))
    last = np.where(stops[we - 1] & (we - ws > 1), we - 1, we) if len(ws) else we
    return common.word_hashes(lower, ws, last), ws, we


def _pieces(data: np.ndarray, offsets: np.ndarray, ws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of at most ``STRETCH`` words within lines, as word ranges."""
    breaks = np.unique(np.concatenate((np.flatnonzero(data == 10), offsets)))
    bounds = np.unique(np.searchsorted(ws, breaks))
    if not len(bounds) or not len(ws):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    start, end = bounds[:-1], bounds[1:]
    n = np.maximum(1, -(-(end - start - STRETCH) // STEP) + 1)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(start, n) + k * STEP
    return first, np.minimum(first + STRETCH, np.repeat(end, n))


def _across(data: np.ndarray, offsets: np.ndarray, ws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of at most ``STRETCH`` words that run across line breaks, but not across blank lines, as word ranges."""
    if not len(ws):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    line = np.searchsorted(np.flatnonzero(data == 10), ws)
    blank = np.flatnonzero(np.diff(line) > 1) + 1
    bounds = np.unique(np.concatenate(([0, len(ws)], blank, np.searchsorted(ws, offsets))))
    start, end = bounds[:-1], bounds[1:]
    n = np.maximum(1, -(-(end - start - STRETCH) // STEP) + 1)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(start, n) + k * STEP
    last = np.minimum(first + STRETCH, np.repeat(end, n))
    some = line[first] < line[last - 1]
    return first[some], last[some]


def _settled(found: list[tuple]) -> list[tuple]:
    """``found`` (document, family, predicted, start, end, ...) without stretches that tell of a family what an earlier one
    of the list tells of the same place, and without unknown ones where a family is confirmed."""
    kept: list[tuple] = []
    of: dict[int, list[tuple]] = {}
    for x in sorted(found, key=lambda x: x[1] == "unknown"):
        mine = of.setdefault(x[0], [])
        if not any(x[3] < y[4] and y[3] < x[4] and x[1] in (y[1], "unknown") for y in mine):
            mine.append(x)
            kept.append(x)
    return sorted(kept, key=lambda x: (x[0], x[3], x[4]))


def _buckets(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.zeros(len(h), dtype=np.uint64)
    if len(h) > 1:
        pairs[:-1] = common.mix(h[:-1] * np.uint64(31) + h[1:])
    return (h % np.uint64(BUCKETS)).astype(np.int64), (pairs % np.uint64(BUCKETS)).astype(np.int64)


class Classifier(NamedTuple):
    weights: np.ndarray  # bucket x class, the last two classes being unknown licences and everything else
    bias: np.ndarray
    temperature: float
    shift: float

    def probabilities(self, h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each word range over the hashes ``h``; two-grams do not leave their range."""
        one, two = _buckets(h)
        sums = np.empty((len(first), self.weights.shape[1]), dtype=np.float32)
        for c in range(0, len(first), 20_000):
            a, z = first[c : c + 20_000], end[c : c + 20_000]
            base, stop = int(a.min()), int(z.max())
            ones = np.zeros((stop - base + 1, self.weights.shape[1]), dtype=np.float32)
            twos = np.zeros_like(ones)
            np.cumsum(self.weights[one[base:stop]], axis=0, out=ones[1:])
            np.cumsum(self.weights[two[base:stop]], axis=0, out=twos[1:])
            sums[c : c + 20_000] = ones[z - base] - ones[a - base] + twos[np.maximum(z - 1, a) - base] - twos[a - base]
        n = (end - first).astype(np.float32)[:, None]
        x = (sums / np.sqrt(np.maximum(2 * n - 1, 1)) + self.bias) / self.temperature
        licence = 1 / (1 + np.exp(-(_margin(x) + self.shift)))
        x = np.exp(x[:, :-1] - x[:, :-1].max(axis=1, keepdims=True))
        return np.column_stack((x / x.sum(axis=1, keepdims=True) * licence[:, None], 1 - licence))


def _margin(x: np.ndarray) -> np.ndarray:
    """Log odds of any licence against everything else."""
    top = x[:, :-1].max(axis=1)
    return np.log(np.exp(x[:, :-1] - top[:, None]).sum(axis=1)) + top - x[:, -1]


def _examples(corpus: list[str], seed: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Paragraphs, their classes, and whether they are held out; all variants of a notice share their fate."""
    rng = np.random.default_rng(seed)
    noise = [w for t in corpus for w in t.split()][:20_000] or "it was a day of rain and the road to town is long".split()
    made_up = [f.format(" ".join(rng.choice(noise, rng.integers(1, 4))).title(), f"{rng.integers(1, 6)}.{rng.integers(0, 10)}") for f in _FRAMES for _ in range(12)]
    # a third notice of a family, every third other licence and every sixth made-up one are held out
    notices = [(t, c, VARIANTS, k == 2) for c, f in enumerate(FAMILIES) for k, t in enumerate(TEMPLATES[f])]
    notices += [(t, UNKNOWN, VARIANTS // 2, k % 3 == 2) for k, f in enumerate(OTHER_LICENCES) for t in OTHER_LICENCES[f]]
    notices += [(t, UNKNOWN, VARIANTS // 6, k % 6 == 5) for k, t in enumerate(made_up)]
    texts, labels, held = [], [], []
    for notice, c, variants, out in notices:
        words = notice.split()
        for v in range(variants):
            kept = [w for w in words if v == 0 or len(words) < 8 or rng.random() > 0.08]
            around = [" ".join(rng.choice(noise, rng.integers(0, 9))) if v % 3 == 2 else "" for _ in range(2)]
            line = f"{around[0]} {' '.join(kept)} {around[1]}".strip()
            texts.append(line.upper() if v % 10 == 9 else line)
            labels.append(c)
            held.append(out)
    licence_like = re.compile("|".join(("licen[sc]e", "copyright", "redistribut")), re.I)
    threes = lambda t: {*zip(w := words_of(t), w[1:], w[2:], strict=False)}
    told = set().union(*map(threes, (t for t, *_ in notices)))  # lines of the corpus that may come from a notice are no counterexamples
    others = [t for t in _OTHER for _ in range(20)] + [t for t in dict.fromkeys(corpus) if t.strip() and not licence_like.search(t) and told.isdisjoint(threes(t))]
    apart = [k // 20 % 3 == 2 if k < 20 * len(_OTHER) else k % 5 == 4 for k in range(len(others))]
    return texts + others, np.array(labels + [len(FAMILIES) + 1] * len(others)), np.array(held + apart)


def train(corpus: list[str], *, seed: int = 7, rounds: int = 150, rate: float = 2.0) -> tuple[Classifier, float]:
    """A calibrated classifier from templates and ``corpus`` paragraphs, and how often a first one, trained without the
    held-out notices and paragraphs, tells licences from other text among these."""
    texts, y, held = _examples(corpus, seed)
    ranges = []
    hs = []
    at = 0
    for t in texts:
        raw = np.frombuffer(t.encode(), dtype=np.uint8)
        h, _, _ = _units(raw, np.array([0, len(raw)]))
        h = h[:STRETCH]
        hs.append(h)
        ranges.append((at, at + len(h)))
        at += len(h)
    h = np.concatenate(hs)
    first, end = np.array(ranges, dtype=np.int64).T
    full = end > first
    first, end, y, held = first[full], end[full], y[full], held[full]
    one, two = _buckets(h)
    row = np.repeat(np.arange(len(y)), end - first)
    words = np.concatenate([np.arange(a, z) for a, z in zip(first, end, strict=True)])
    inner = words + 1 < np.repeat(end, end - first)
    rows = np.concatenate((row, row[inner]))
    cols = np.concatenate((one[words], two[words[inner]]))
    value = (1 / np.sqrt(2 * (end - first) - 1)).astype(np.float32)[rows]
    known, cols = np.unique(cols, return_inverse=True)
    k = len(FAMILIES) + 2
    by_row, by_col = np.argsort(rows, kind="stable"), np.argsort(cols, kind="stable")
    row_cut, col_cut = np.flatnonzero(np.diff(rows[by_row], prepend=-1)), np.flatnonzero(np.diff(cols[by_col], prepend=-1))
    target = np.eye(k, dtype=np.float32)[y]
    soft = lambda x: (e := np.exp(x - x.max(axis=1, keepdims=True))) / e.sum(axis=1, keepdims=True)

    def scores(w: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[cols[by_row]] * value[by_row, None], row_cut, axis=0) + b

    def fitted(mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((len(known), k), dtype=np.float32), np.zeros(k, dtype=np.float32)
        weight = (1 / np.bincount(y[mine], minlength=k).clip(1))[y] * mine
        weight = (weight / weight.sum())[:, None].astype(np.float32)
        gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
        for _ in range(rounds):
            g = (soft(scores(w, b)) - target) * weight
            dw = np.add.reduceat(g[rows[by_col]] * value[by_col, None], col_cut, axis=0) + 1e-6 * w
            db = g.sum(axis=0)
            gw += dw * dw
            gb += db * db
            w -= rate * dw / np.sqrt(gw)
            b -= rate * db / np.sqrt(gb)
        return w, b

    x = scores(*fitted(~held))[held]
    other = y[held] == k - 1

    odd = np.where(other, (1 - LICENCE_SHARE) / max(other.sum(), 1), LICENCE_SHARE / max((~other).sum(), 1))
    scale = np.linspace(-15, 15, 121)

    def loss(t: float) -> tuple[float, float]:  # of the best shift, and the shift
        z = (np.where(other, 1, -1) * _margin(x / t))[:, None] + np.where(other, 1, -1)[:, None] * scale
        # smoothed targets keep probabilities off 0 and 1 where the held-out ones can be told apart without fault
        far = (odd[:, None] * (0.99 * np.logaddexp(0, z) + 0.01 * np.logaddexp(0, -z))).sum(axis=0)
        return float(far.min()), float(scale[far.argmin()])

    temperature = min(np.geomspace(0.5, 8, 31), key=loss)
    shift = loss(temperature)[1]
    w, b = fitted(np.ones(len(y), dtype=bool))
    weights = np.zeros((BUCKETS, k), dtype=np.float32)
    weights[known] = w
    return Classifier(weights, b, float(temperature), shift), float(((_margin(x / temperature) + shift < 0) == other).mean())


def similarity(text: str, family: str) -> float:
    """The largest share of a template's words that the text has in order."""
    have = words_of(text)
    best = 0.0
    for template in TEMPLATES[family]:
        want = words_of(template)
        blocks = difflib.SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks()
        best = max(best, sum(m.size for m in blocks) / len(want))
    return best


def _pairs(text: str) -> set[tuple[str, str]]:
    w = words_of(text)
    return {*zip(w, w[1:], strict=False)}


_KNOWN_PAIRS = frozenset().union(*(_pairs(part) for told in (*TEMPLATES.values(), *OTHER_LICENCES.values(), _FRAMES) for t in told for part in t.split("{}")))


def named(text: str, family: str) -> bool:
    """Whether ``text`` holds a name of the family and none of its siblings'; one that ends within a word may be either's."""
    if text.endswith("-"):
        return False
    flat = f" {' '.join(w for x in words_of(text) for w in x.split('-') if w)} "
    names, others = NAMES[family]
    return any(f" {x} " in flat for x in names) and not any(f" {x} " in flat for x in others)


def find_licenses(docs: DataFrame, *, training_documents: int = TRAINING_DOCUMENTS, likely: float = LIKELY, confirm: float = CONFIRM) -> DataFrame:
    """One row for each licence paragraph of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.char_length(F.trim(x)) > 0)
    mark = F.xxhash64("doc_id", "text")
    # the least hashes of different documents, and one row of each: a row that repeats a million times is taken once
    least = rows.select(mark.alias("h")).distinct().orderBy("h").limit(training_documents).agg(F.max("h")).first()[0]
    mixed = F.array_sort(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.substring(x, 1, PARAGRAPH_CHARACTERS).alias("p"))))
    sample = rows.filter(mark <= F.lit(least)).select(mark.alias("h"), F.slice(mixed, 1, PARAGRAPHS_EACH)["p"].alias("p")).groupBy("h").agg(F.first("p").alias("p"))
    corpus = sorted(p for r in sample.collect() for p in (r.p or []))
    model, _ = train(corpus)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier: Classifier = held.value
        for b in batches:
            ids = b.column(0).to_pylist()
            out = []
            for i, _, data, offsets in common.text_slices(b.column(1), common.SLICE_BYTES // 2):
                h, ws, we = _units(data, offsets)
                first, end = _pieces(data, offsets, ws)
                if not len(first):
                    continue
                lines = len(first)
                first, end = (np.concatenate(x) for x in zip((first, end), _across(data, offsets, ws), strict=True))
                p = classifier.probabilities(h, first, end)
                some = np.flatnonzero(1 - p[:, -1] >= likely)
                last, told = None, []
                for x in some.tolist():
                    s, e = int(ws[first[x]]), int(we[end[x] - 1])
                    best = int(p[x, :-1].argmax())
                    text = data[s:e].tobytes().decode("utf-8", "replace")
                    # the two likeliest families are compared; a name decides between siblings
                    near = [(similarity(text, FAMILIES[c]), FAMILIES[c]) for c in np.argsort(-p[x, :UNKNOWN], kind="stable")[:2].tolist()]
                    sure = [f for a, f in near if a >= confirm and named(text, f)]
                    alike = max(a for a, f in near if f == sure[0]) if sure else near[0][0]
                    if not sure and len(_KNOWN_PAIRS & _pairs(text)) < SHARED_PAIRS:
                        continue
                    family = sure[0] if sure else "unknown"
                    d = int(np.searchsorted(offsets, s, "right")) - 1
                    if last and last[0] == d and last[1] == family and x < lines and s < last[2]:  # the same notice in the next stretch
                        last = (d, family, e)
                        continue
                    last = (d, family, e)
                    told.append((d, family, (*FAMILIES, "unknown")[best], s - int(offsets[d]), e - int(offsets[d]), float(1 - p[x, -1]), alike))
                out += [(ids[i + d], *rest) for d, *rest in _settled(told)]
            if out:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "family", "predicted", "start_byte", "end_byte", "probability", "similarity"])

    return rows.mapInArrow(run, SCHEMA)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(common.documents(spark, sf_dir))
