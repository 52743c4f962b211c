"""Finding licence texts in documents: MinHash bands over text windows, then exact containment.

A match of a template is a stretch of a document, SLACK times as many shingles long as the
template, that holds at least `threshold` of the template's distinct shingles (five words
each), so a page header or an owner's line inside a notice does not hide it. Comment marks at
the edges of words do not count. Overlapping stretches make one match.

Documents are cut into overlapping windows. A window's MinHash values are its bands; a
template is a candidate where one band equals its own. Windows are long enough that every
stretch lies whole in one of them, which bounds the resemblance of that window and the
template from below; the number of bands follows from the bound so that a match is missed
with probability MISS at most. Candidates are then verified word by word.

Everything happens inside the task that reads the document: no shuffle, and the templates
are given by the caller, not taken from the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from leakloom.llm import common

SHINGLE = 5
#: Length of a stretch against its template's.
SLACK = 2.0
#: Largest probability of missing a match.
MISS = 1e-9
#: Words that are hashed at a time, and words whose hashes a worker keeps.
STREAM, CACHE = 100_000, 500_000

# Wordings of notices as their publishers give them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("mit-line", "Released under the MIT License."),
    (
        "apache-2.0-notice",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    (
        "mit-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ),
    (
        "bsd-conditions",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ),
    (
        "bsd-3-endorsement",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    (
        "mit-warranty",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc-grant",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "0bsd-grant",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ),
    (
        "gpl-2.0-or-later-notice",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
    ),
    (
        "gpl-3.0-or-later-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    (
        "lgpl-2.1-or-later-notice",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version.",
    ),
    (
        "agpl-3.0-or-later-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
    ),
    (
        "gnu-warranty",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "mpl-2.0-notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "epl-2.0-notice",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "unlicense-dedication",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib-grant",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software.",
    ),
    (
        "bsl-1.0-grant",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit "
        "the Software, and to prepare derivative works of the Software.",
    ),
    (
        "cc-by-4.0-line",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    (
        "cc-by-sa-4.0-line",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
)

_EDGE = b"\"'()[]{}<>.,;:!?*#/|-%"
_ODD = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, size=(2, 512), dtype=np.uint64)
_FACTORS, _ADDENDS = _ODD[0] | np.uint64(1), _ODD[1]
_PLACES = np.random.Generator(np.random.PCG64(21)).integers(0, 2**64, size=SHINGLE, dtype=np.uint64) | np.uint64(1)


def words_of(text: bytes) -> tuple[list[bytes], list[int]]:
    """Lower-case words without punctuation at their ends, and their places among all words."""
    bare = [w.strip(_EDGE) for w in text.translate(common.LOWER).split()]
    at = [i for i, w in enumerate(bare) if w]
    return ([bare[i] for i in at], at) if len(at) < len(bare) else (bare, at)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """One hash for each run of SHINGLE words."""
    n = len(hashes) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, place in enumerate(_PLACES):
        total += hashes[i : i + n] * place
    return _mixed(total)


class Template(NamedTuple):
    name: str
    shingles: frozenset[tuple[bytes, ...]]
    stretch: int  # shingles in which a match has to lie
    need: int  # distinct shingles that a match holds
    stride: int
    blocks: int  # strides of a window
    bands: np.ndarray


def read_templates(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(name, text) of every .txt file of a folder, named like the file; templates are few by nature."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(folder)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1)
    return sorted((r["name"], r["value"]) for r in files.select(name.alias("name"), "value").collect())


def band_count(need: int, distinct: int, window: int) -> int:
    """Bands of one MinHash value each, so that a window with a match is missed with probability MISS at most."""
    resemblance = need / (window + distinct - need)
    return 1 if resemblance >= 1 else math.ceil(math.log(MISS) / math.log(1 - resemblance))


def prepared(templates: Sequence[tuple[str, str]], threshold: float) -> list[Template]:
    out = []
    for name, text in templates:
        words, _ = words_of(text.encode())
        if len(words) < SHINGLE:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        length = len(words) - SHINGLE + 1
        shingles = frozenset(tuple(words[i : i + SHINGLE]) for i in range(length))
        need = math.ceil(threshold * len(shingles) - 1e-9)
        stretch = math.ceil(SLACK * length)
        stride = max(1, stretch // 3)
        blocks = math.ceil((stretch + stride - 1) / stride)
        count = band_count(need, len(shingles), blocks * stride)
        if count > _FACTORS.size:
            raise ValueError(f"template {name}: threshold {threshold} needs too many bands")
        own = shingle_hashes(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64))
        bands = (own[:, None] * _FACTORS[:count] + _ADDENDS[:count]).min(axis=0)
        out.append(Template(name, shingles, stretch, need, stride, blocks, bands))
    return out


def candidates(shingles: np.ndarray, templates: Sequence[Template]) -> Iterator[tuple[int, np.ndarray]]:
    """Index of a template and the first places of the windows that share a band with it."""
    if not len(shingles):
        return
    found = {}
    for band in range(max(len(t.bands) for t in templates)):
        values = shingles * _FACTORS[band] + _ADDENDS[band]
        minima: dict[tuple[int, int], np.ndarray] = {}
        for i, t in enumerate(templates):
            if band >= len(t.bands):
                continue
            if (t.stride, t.blocks) not in minima:
                blocks = values if t.stride == 1 else np.minimum.reduceat(values, np.arange(0, len(values), t.stride))
                least = blocks.copy()
                for k in range(1, min(t.blocks, len(blocks))):
                    np.minimum(least[:-k], blocks[k:], out=least[:-k])
                minima[t.stride, t.blocks] = least
            hit = minima[t.stride, t.blocks] == t.bands[band]
            if hit.any():
                found[i] = found[i] | hit if i in found else hit
    for i, hit in found.items():
        yield i, np.flatnonzero(hit) * templates[i].stride


def verified(words: list[bytes], t: Template) -> list[tuple[int, int, float]]:
    """First word, word count and containment of each match of a template in a document."""
    hits = [(i, s) for i in range(len(words) - SHINGLE + 1) if (s := tuple(words[i : i + SHINGLE])) in t.shingles]
    spans: list[list[int]] = []
    held: dict[tuple[bytes, ...], int] = {}
    end = 0
    for low, (at, s) in enumerate(hits):
        while end < len(hits) and hits[end][0] < at + t.stretch:
            held[hits[end][1]] = held.get(hits[end][1], 0) + 1
            end += 1
        if len(held) >= t.need:
            if spans and low <= spans[-1][1]:
                spans[-1][1] = end - 1
            else:
                spans.append([low, end - 1])
        held[s] -= 1
        if not held[s]:
            del held[s]
    return [
        (hits[a][0], hits[b][0] + SHINGLE - hits[a][0], len({s for _, s in hits[a : b + 1]}) / len(t.shingles))
        for a, b in spans
    ]


class _Scanner:
    """Scans documents in streams of about STREAM words, so that small documents share the array work."""

    def __init__(self, templates: Sequence[Template]):
        self.templates = templates
        self._known: dict[bytes, int] = {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words) if w not in known)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def matches(self, docs: list[list[bytes]]) -> Iterator[tuple[int, Template, tuple[int, int, float]]]:
        """Windows may reach over the end of a document; verification looks at one document only."""
        if not docs or not self.templates:
            return
        ends = np.cumsum([len(d) for d in docs])
        stream = shingle_hashes(np.concatenate([self._hashes(d) for d in docs]))
        for i, places in candidates(stream, self.templates):
            t = self.templates[i]
            first = np.searchsorted(ends, places, side="right")
            last = np.searchsorted(ends, np.minimum(places + t.stride * t.blocks, len(stream)) - 1, side="right")
            touched = {d for a, b in zip(first.tolist(), last.tolist()) for d in range(a, b + 1)}
            for d in sorted(touched):
                for span in verified(docs[d], t):
                    yield d, t, span


MATCHES = "doc_id long, license string, start_word long, n_words long, containment double"


def scan(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """All matches: doc_id, license, start_word (from 0), n_words, containment.

    Words are runs of anything but six ASCII blanks. Null, empty and short texts match
    nothing; every repeated row has its matches, and ties between templates all count; very
    long texts are searched whole, in streams; an empty table gives no rows. start_word and
    n_words count all words of the document, punctuation included. Other columns are not used.
    """
    known = prepared(templates, threshold)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(known)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            out: list[tuple] = []
            group: list[tuple] = []
            size = 0

            def flush():
                for d, t, (at, n, share) in scanner.matches([w for _, w, _ in group]):
                    doc, _, places = group[d]
                    out.append((doc, t.name, places[at], places[at + n - 1] - places[at] + 1, share))

            for doc, data in zip(ids, texts):
                words, places = words_of(data or b"")
                if len(words) < SHINGLE:
                    continue
                group.append((doc, words, places))
                size += len(words)
                if size >= STREAM:
                    flush()
                    group, size = [], 0
            flush()
            columns = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["doc_id", "license", "start_word", "n_words", "containment"],
            )

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(search, MATCHES)
