"""Licence scans.

Overlapping windows of a text's five-word shingles get MinHash signatures; bands of them retrieve templates, and the
exact share of a template's shingles that the window holds decides. Window sizes follow the templates' lengths so that
some window holds any place where a template can stand and is at most about twice as long: for a whole copy the
Jaccard index of window and template is 0.5 at least, for a containment of just 0.8 about 0.36; 64 bands of 2 rows
miss the one with a probability of 0.00000001, the other with 0.00014.
A window without any shingle of any template cannot match and is passed over.

Words are runs of letters and digits with A-Z lower-cased. Defined results: null, empty and very short texts hold no
template; templates of fewer than five words are refused; a template that stands in a text more than once gives one
row, at its best place (the first of equals); equal rows give equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenq.llm import wordscan as W
from lumenq.llm.columns import id_schema, map_batches, plain_names

# Public licence notices and declarations.
TEMPLATES: list[tuple[str, str]] = [
    ("mit-line", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-line", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."),
]


@dataclass(frozen=True)
class Settings:
    """shingle: words. containment: share of a template's shingles. bands and rows of the signatures."""

    shingle: int = 5
    containment: float = 0.8
    bands: int = 64
    rows: int = 2


#: Templates are a parameter, not a table that grows; more than so many bytes are refused.
MOST_TEMPLATE_BYTES = 4 << 20


class Templates:
    def __init__(self, rows: list[tuple[str, str]], s: Settings):
        if sum(len(t.encode()) for _, t in rows) > MOST_TEMPLATE_BYTES:
            raise ValueError(f"templates may have {MOST_TEMPLATE_BYTES} bytes in all; split them over several scans")
        self.ids = [i for i, _ in rows]
        self.sets: list[np.ndarray] = []
        for name, text in rows:
            g = shingles(W.utf8_runs([text]), s.shingle)[0]
            if not len(g):
                raise ValueError(f"template {name} has fewer than {s.shingle} words")
            self.sets.append(np.unique(g))
        self.all = W.HashSet(np.concatenate(self.sets))
        self.s = s
        self.seeds = np.random.Generator(np.random.PCG64(11)).integers(0, 2**64, s.bands * s.rows, dtype=np.uint64)
        self.windows: dict[int, dict[tuple, list[int]]] = {}
        for k, own in enumerate(self.sets):
            table = self.windows.setdefault(window_of(len(own)), {})
            for key in self.keys(own):
                table.setdefault(key, []).append(k)
        self.of_window = {size: W.HashSet(np.concatenate([x for x in self.sets if window_of(len(x)) == size])) for size in self.windows}

    def keys(self, g: np.ndarray) -> list[tuple]:
        """The bands of a set's signature."""
        low = W.mix(g[None, :] ^ self.seeds[:, None]).min(axis=1).reshape(self.s.bands, self.s.rows)
        return [(b, *row) for b, row in enumerate(low.tolist())]


def window_of(n: int) -> int:
    """Shingles of a window for a template of n: three quarters of it hold the template."""
    size = 2
    while 3 * size < 4 * n:
        size = -(-3 * size // 2)
    return size


def shingles(run: W.Run, n: int) -> tuple[np.ndarray, np.ndarray, W.Words]:
    w = W.words(run, W.NOT_ALNUM)
    g, first = W.ngrams(W.span_hashes(run, w.start, w.end, lower=True), w.doc, n)
    return g, first, w


def _scan(column: pa.Array, t: Templates) -> Iterator[tuple]:
    """(row, template, first word, end word, containment)."""
    n = t.s.shingle
    for run in W.runs(column):
        g, first, w = shingles(run, n)
        if not len(t.all.find(g)[0]):
            continue
        doc = w.doc[first]
        head, tail = np.searchsorted(doc, np.arange(len(run))), np.searchsorted(doc, np.arange(len(run)), side="right")
        word0 = np.searchsorted(w.doc, np.arange(len(run)))
        best: dict[tuple[int, int], tuple] = {}
        for size, table in t.windows.items():
            step = max(1, size // 4)
            # the windows of each text begin at every step from its first shingle; only those with a hit count
            wanted = set()
            for x in t.of_window[size].find(g)[0].tolist():
                d = int(doc[x])
                place = x - int(head[d])
                for k in range(max(0, -(-(place - size + 1) // step)), place // step + 1):
                    wanted.add((d, int(head[d]) + k * step))
            for d, lo in sorted(wanted):
                hi = min(lo + size, int(tail[d]))
                own = np.unique(g[lo:hi])
                for k in sorted({k for key in t.keys(own) for k in table.get(key, ())}):
                    inside = np.isin(g[lo:hi], t.sets[k])
                    share = len(np.unique(g[lo:hi][inside])) / len(t.sets[k])
                    if share >= t.s.containment and share > best.get((d, k), (0.0,))[0]:
                        at = np.flatnonzero(inside)
                        begin, end = int(first[lo + at[0]]), int(first[lo + at[-1]]) + n
                        best[d, k] = (share, begin - int(word0[d]), end - int(word0[d]))
        for (d, k), (share, begin, end) in sorted(best.items()):
            yield run.lo + d, k, begin, end, share


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, settings: Settings = Settings()) -> DataFrame:
    """One row for each document and template that it holds: the place in words, and the share of the template."""
    t = Templates(templates if templates is not None else TEMPLATES, settings)
    schema = id_schema(docs, id_col, "license_id string, start_word long, end_word long, containment double")

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        found = list(_scan(batch.column(1), t))
        if found:
            types = to_arrow_schema(schema)
            rows, which, begin, end, share = zip(*found, strict=True)
            arrays = [batch.column(0).take(pa.array(rows)).cast(types.field(0).type), pa.array([t.ids[k] for k in which]), *[pa.array(v, type=f.type) for v, f in zip((begin, end, share), list(types)[2:], strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, schema=types)

    return map_batches(plain_names(docs, id_col, text_col), find, schema)
