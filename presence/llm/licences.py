"""Licence scans by the Dice coefficient over word bigrams.

Texts and templates are normalised to lower-case words without signs at
their ends. A template is the set of its word bigrams. In a text, the places
whose bigram belongs to a template are gathered into spans (a gap ends a span
where more words pass than the template's size bound allows); a span is
compared with a template only if its size could reach the threshold:
Dice >= t needs |A| between t/(2-t) |B| and (2-t)/t |B|. For each place where
a copy can begin, running counts of distinct bigrams give the best end. Of
overlapping finds the one that holds most of its template stays.

Nulls: a null text is empty; a null id is kept as null. Repeated rows are
scanned each. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presence.llm.textkit import Words, hash_spans, lookup, mix, per_slice, words_of

THRESHOLD = 0.8

# Notices and opening paragraphs of public licences: fixed values.
TEMPLATES = [
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "text", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MIT", "grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("BSD", "notice", "Licensed under the BSD License."),
    ("BSD-3-Clause", "notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("GPL-3.0", "notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL", "short", "Licensed under the GNU General Public License."),
    ("GPL-3.0", "work", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL", "notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", "grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "notice", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "notice", "All rights reserved. Unauthorized copying of this file, via any medium is strictly prohibited."),
]


def bigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bigram hashes and the word each begins at, within rows."""
    h = hash_spans(words.data, *words.cores())
    if len(h) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pair = mix(h[:-1] * np.uint64(0xFF51AFD7ED558CCD) ^ (h[1:] + np.uint64(1)))
    inside = np.ones(len(pair), bool)
    cut = words.first[1:-1] - 1
    inside[cut[(cut >= 0) & (cut < len(pair))]] = False
    at = np.flatnonzero(inside)
    return pair[at], at


@cache
def templates() -> tuple[list[np.ndarray], np.ndarray]:
    """Bigram sets by template, and all their bigrams."""
    sets = [np.unique(bigrams(words_of(pa.array([text])))[0]) for _, _, text in TEMPLATES]
    return sets, np.unique(np.concatenate(sets))


def dice(a: np.ndarray, b: np.ndarray) -> float:
    return 2 * len(np.intersect1d(a, b)) / (len(a) + len(b)) if len(a) + len(b) else 0.0


def _finds(pair: np.ndarray, at: np.ndarray, hit: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(template, first word, words, Dice) over one row's bigrams. Where finds
    overlap, the one that holds most of its template's bigrams stays, so a
    whole text is not hidden by a short form that opens it."""
    sets, _ = templates()
    before = _before(pair)
    out = []
    for t, own in enumerate(sets):
        mine = hit[lookup(pair[hit], own) >= 0]
        most = int((2 - THRESHOLD) / THRESHOLD * len(own))
        for region in np.split(mine, np.flatnonzero(np.diff(mine) > max(1, most - len(own))) + 1):
            if len(np.unique(pair[region])) < THRESHOLD / (2 - THRESHOLD) * len(own):
                continue
            for a, b, matched, score in _copies(region, before, len(own), most):
                out.append((matched, score, t, int(at[a]), int(at[b] - at[a] + 2)))
    out.sort(key=lambda f: (-f[0], -f[1], f[3], f[2]))
    kept = _apart(out, lambda f: (f[3], f[3] + f[4] - 1))
    return sorted(((t, start, n, score) for _, score, t, start, n in kept), key=lambda f: f[1])


def _apart(found: list, ends: Callable[[tuple], tuple[int, int]]) -> list:
    """Those that overlap none before them in the list."""
    kept, taken = [], []  # taken: (first, last), in order
    for f in found:
        place = ends(f)
        i = bisect_right(taken, place)
        if (not i or taken[i - 1][1] < place[0]) and (i == len(taken) or place[1] < taken[i][0]):
            taken.insert(i, place)
            kept.append(f)
    return kept


def _before(pair: np.ndarray) -> np.ndarray:
    """Where each bigram stood last before, or -1."""
    order = np.argsort(pair, kind="stable")
    out = np.full(len(pair), -1, np.int64)
    same = pair[order[1:]] == pair[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _copies(region: np.ndarray, before: np.ndarray, size: int, most: int) -> list[tuple[int, int, int, float]]:
    """(first and last bigram, template bigrams held, Dice) of the copies of
    one template among hits that lie close: for every hit as the first, the
    best of all hits as the last within the size bound, from running counts
    of distinct bigrams; of overlapping ones the best."""
    found = []
    for i, a in enumerate(region.tolist()):
        ends = region[i : np.searchsorted(region, a + most)]
        new = before[a : ends[-1] + 1] < a
        total = np.cumsum(new)[ends - a]
        matched = np.cumsum(new[ends - a])
        score = 2 * matched / (total + size)
        k = len(score) - 1 - int(np.argmax(score[::-1]))  # the longest of equal ones
        if score[k] >= THRESHOLD:
            found.append((a, int(ends[k]), int(matched[k]), float(score[k])))
    found.sort(key=lambda f: (-f[3], f[0] - f[1], f[0]))
    return _apart(found, lambda f: f[:2])


def scan(docs: DataFrame) -> DataFrame:
    """One row per find: doc_id, licence, form, dice, first_word, n_words."""

    def work(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        pair, at = bigrams(words)
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        hit = np.flatnonzero(lookup(pair, templates()[1]) >= 0)
        row = np.searchsorted(words.first, at[hit], "right") - 1
        rows = []
        for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(row)) + 1):
            if len(part) < 2:
                continue
            r = int(row[part[0]])
            lo, hi = np.searchsorted(at, words.first[r : r + 2])
            for t, start, n, score in _finds(pair[lo:hi], at[lo:hi] - words.first[r], hit[part] - lo):
                rows.append((ids[r], TEMPLATES[t][0], TEMPLATES[t][1], score, start, n))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(
        per_slice("text", work), "doc_id long, licence string, form string, dice double, first_word long, n_words long"
    )


NAMES = ["doc_id", "licence", "form", "dice", "first_word", "n_words"]
