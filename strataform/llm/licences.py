"""Licence scan: MinHash bands over overlapping text windows, then exact shingle containment.

Texts and templates are compared in lower case with runs of white space as one blank, by shingles
of `K` characters. A text is cut into blocks of 32 characters; windows of 64, 128, ... characters
start at every half window, so that any passage of at most half a window lies in one of them whole.
A template is looked for in the windows of at least twice its length and less than four times it.

Each of `HASHES` bands is one hash function's least value. The bands of all templates are a table
from (band, value) to templates, in which a window's values are looked up; a bit table of a fixed
size passes over the values that no template has. What agrees in `HITS` bands is a candidate: where
a window holds 80 % of a template's shingles their similarity is at least 0.8 / 4.2 = 0.19, and two
of 64 values agree with probability 0.9999. Candidates are verified: the share of the template's
shingles that lie in the window must reach `percent`. Verified windows of one template that overlap
are one spot, with the best window's share and place; every spot is returned.

Defined results
    null or empty text: no windows, no matches. Texts shorter than a window are one window.
    repeated rows and ties: each row by itself; licence names are sorted and distinct.
    very long texts: every window. Empty table: empty result. No templates: no matches.
    templates with a null or blank text are ignored. Of windows of a spot that tie, the first.
    other columns are kept unless an output column has the same name.

A map over rows; templates are a bounded parameter (`MAX_TEMPLATES` characters in all, else an
error). Memory follows the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.llm import shingles
from strataform.llm.linededup import grams, normal
from strataform.llm.names import unused
from strataform.session import lean, ship_package

K, BLOCK, HASHES, HITS, PERCENT = 6, 32, 64, 2, 80
#: Characters of all templates together; they are sent to every worker.
MAX_TEMPLATES = 16_000_000
#: Bits of the table that tells which (band, value) no template has.
_BITS = 1 << 20

_PERMISSIVE_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_CLAUSES = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Licence names with the notices that state them, and whole short licences.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _PERMISSIVE_END),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _PERMISSIVE_END),
    ("bsd-2-clause", _BSD_START + _BSD_CLAUSES + _BSD_END),
    ("bsd-3-clause", _BSD_START + _BSD_CLAUSES + _BSD_THIRD + _BSD_END),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
)


class Scanner:
    """Templates with their bands, by window size."""

    def __init__(self, templates=TEMPLATES, percent: int = PERCENT, k: int = K):
        self.percent, self.k = percent, k
        self.names, self.sets, self.level = [], [], []
        seeds = shingles.mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64)).astype(np.uint32)
        self.mul, self.add = seeds[::2] | np.uint32(1), seeds[1::2]
        for name, text in templates:
            line = normal(text or "")
            if not line:
                continue
            self.names.append(name)
            self.sets.append(np.unique(grams([line], k)[0]))
            level = 1
            while BLOCK << (level - 1) < len(line):
                level += 1
            self.level.append(level)
        low = [((s >> np.uint64(32)).astype(np.uint32)[:, None] * self.mul + self.add).min(axis=0) for s in self.sets]
        signs = np.array(low, np.uint32).reshape(-1, HASHES)
        self.bands = {}
        for level in sorted(set(self.level)):
            of = np.array([t for t, x in enumerate(self.level) if x == level])
            key = self._keys(signs[of]).ravel()
            order = np.argsort(key, kind="stable")
            some = np.zeros(_BITS, bool)
            some[self._slot(key)] = True
            self.bands[level] = (key[order], np.repeat(of, HASHES)[order], some)

    @staticmethod
    def _keys(values: np.ndarray) -> np.ndarray:
        """(rows, bands) values as numbers that hold the band as well."""
        return (np.arange(HASHES, dtype=np.uint64) << np.uint64(32)) | values.astype(np.uint64)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def _candidates(self, level: int, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (rows of `low`) and templates that agree in at least `HITS` bands."""
        known, owner, some = self.bands[level]
        key = self._keys(low)
        window, band = np.nonzero(some[self._slot(key)])
        key = key[window, band]
        first, last = np.searchsorted(known, key), np.searchsorted(known, key, side="right")
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair, hits = np.unique(np.repeat(window, n) * np.int64(len(self.names)) + owner[at], return_counts=True)
        pair = pair[hits >= HITS]
        return pair // len(self.names), pair % len(self.names)

    def _held(self, t: int, window: np.ndarray) -> int:
        """Shingles of a template that lie in a window."""
        own = self.sets[t]  # sorted
        at = np.searchsorted(own, window)
        at[at == len(own)] = 0
        found = np.zeros(len(own), bool)
        found[at[own[at] == window]] = True
        return int(found.sum())

    def scan(self, texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int, int]]]]:
        """For each text the number of windows, and its spots: template, shingles held by the best window, that window's first character."""
        lines = [normal(t) if t else "" for t in texts]
        some = [k for k, x in enumerate(lines) if x]
        n_windows = [0] * len(texts)
        spots: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not some or not self.names:
            return n_windows, spots
        g, bounds = grams([lines[k] for k in some], self.k)
        count = np.diff(bounds)
        blocks = -(-count // BLOCK)
        first = np.cumsum(blocks) - blocks
        doc = np.repeat(np.arange(len(some)), blocks)
        number = np.arange(len(doc)) - first[doc]
        start = bounds[doc] + number * BLOCK
        h = (g >> np.uint64(32)).astype(np.uint32)
        low = np.empty((len(doc), HASHES), np.uint32)
        step = 2048  # blocks at a time, so that their shingles stay in the cache
        for a in range(0, len(doc), step):
            at = start[a : a + step]
            end = start[a + step] if a + step < len(doc) else len(g)
            part = h[at[0] : end]
            for r in range(HASHES):
                low[a : a + step, r] = np.minimum.reduceat(part * self.mul[r] + self.add[r], at - at[0])
        last = (first + blocks - 1)[doc]
        verified: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        own = np.arange(len(doc))
        for level in range(1, max(self.level) + 1):
            # windows of this level begin at every half of one; its other half is the next such place of the level before
            rows = np.flatnonzero(number[own] % (1 << (level - 1)) == 0)
            more = own[rows] + (1 << (level - 1)) <= last[own[rows]]
            low = np.minimum(low[rows], low[np.where(more, rows + min(level, 2), rows)])
            own = own[rows]
            for k, n in enumerate(np.bincount(doc[own], minlength=len(some)).tolist()):
                n_windows[some[k]] += n
            for a in range(0, len(own) if level in self.bands else 0, 8192):
                window, template = self._candidates(level, low[a : a + 8192])
                for w, t in zip(own[a + window].tolist(), template.tolist(), strict=True):
                    d = int(doc[w])
                    stop = min(int(start[w]) + (BLOCK << level), int(bounds[d + 1]))
                    held = self._held(t, g[start[w] : stop])
                    if 100 * held >= self.percent * len(self.sets[t]):
                        verified.setdefault((d, t), []).append((int(start[w] - bounds[d]), int(stop - bounds[d]), held))
        for (d, t), windows in sorted(verified.items()):
            best, reach = None, -1
            for at, stop, held in sorted(windows):
                if best is not None and at >= reach:
                    spots[some[d]].append((t, *best))
                    best = None
                if best is None or held > best[0]:
                    best = (held, at)
                reach = max(reach, stop)
            spots[some[d]].append((t, *best))
        return n_windows, spots


def template_rows(templates: DataFrame, name_col: str = "name", text_col: str = "text") -> list[tuple[str, str]]:
    """A table of templates as the parameter of `scan`; refuses more than `MAX_TEMPLATES` characters."""
    size = templates.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    if size > MAX_TEMPLATES:
        raise ValueError(f"templates of {size} characters; at most {MAX_TEMPLATES} are sent to the workers")
    return [tuple(r) for r in templates.select(name_col, text_col).orderBy(name_col, text_col).collect()]


def scan(docs: DataFrame, text_col: str = "text", templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """Adds n_windows, licences (sorted names) and spots (name, containment in percent, first character of the window).

    `templates`: (name, text) pairs, or a table with these columns.
    """
    ship_package(docs.sparkSession)
    if isinstance(templates, DataFrame):
        templates = template_rows(templates)
    made = ["n_windows", "licences", "spots"]
    kept = [c for c in docs.columns if c not in made]
    text = text_col if text_col in kept else unused(kept, "text_read")
    source = docs.select(*(F.col(f"`{c}`") for c in kept), *([] if text == text_col else [F.col(f"`{text_col}`").alias(text)]))
    spot = T.StructType([T.StructField("name", T.StringType()), T.StructField("percent", T.LongType()), T.StructField("at", T.LongType())])
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField("n_windows", T.LongType()), T.StructField("licences", T.ArrayType(T.StringType())), T.StructField("spots", T.ArrayType(spot))])
    spot_type = pa.list_(pa.struct([("name", pa.string()), ("percent", pa.int64()), ("at", pa.int64())]))

    def run(batches):
        scanner = Scanner(templates, percent)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in shingles.pieces(texts, 1_000_000):
                windows, found = scanner.scan(texts[a:b])
                names = [sorted({scanner.names[t] for t, _, _ in m}) for m in found]
                spots = [[{"name": scanner.names[t], "percent": 100 * n // len(scanner.sets[t]), "at": at} for t, n, at in m] for m in found]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(windows, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spots, spot_type)], [*kept, *made])

    return source.mapInArrow(lean(run), schema)
