"""License scan: winnowed fingerprints of the templates pick candidates, banded alignment reports matches.

An inverted index maps the fingerprints of the templates to their places. A text is winnowed the same way;
a fingerprint that it shares with a template names the template and a diagonal. If enough of the template's
words stand around it, the bands of diagonals beside it are aligned word by word. A match that may lack
``n - need`` of a template's ``n`` words has, if these changes break it no more than ``n - need`` times, a run of
``need / (n - need + 1)`` equal words, and k and window of each template are such that every run of this length
keeps a common fingerprint. So every such match is found, wherever its changes are; more breaks than that
(words put in at further places) need one such run. The index grows with the list of templates alone,
which is handed in by the caller and travels with the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from topiclake.llm.text import ALNUM, LOWER, Words, buffers, large, ragged, slices
from topiclake.llm.winnow import split_span, winnow

# Notices and whole texts of common licenses.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "mit-line": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies."
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version."
    ),
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc0-line": "To the extent possible under law, the author has waived all copyright and related rights.",
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: 1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS "
        "IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
        "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
        "THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-third-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will "
        "the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and "
        "to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software. 3. This notice may not be "
        "removed or altered from any source distribution."
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of "
        "the software and accompanying documentation covered by this license (the \"Software\") to use, "
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative "
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so, "
        "all subject to the following"
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
        "modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
        "of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "mpl-2.0-heading": "Mozilla Public License Version 2.0",
    "gpl-2.0-heading": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-3.0-heading": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl-2.1-heading": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl-3.0-heading": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation; either version 2 of "
        "the License, or (at your option) any later version."
    ),
    "lgpl-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the "
        "GNU Lesser General Public License as published by the Free Software Foundation; either version "
        "2.1 of the License, or (at your option) any later version."
    ),
    "agpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU Affero General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version."
    ),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        "the GNU General Public License for more details."
    ),
}

def _words(text: str) -> tuple[Words, np.ndarray]:
    data, offsets = buffers(large(pa.array([text])))
    words = Words(LOWER[data], offsets, ALNUM)
    return words, words.hashes()


class Index:
    """Inverted index of the templates' fingerprints, for matches of a coverage.

    ``need`` matched words are asked of a template. Its ``reach`` bounds how far the words left out or put
    in may shift a match: by ``2 * reach`` at least. ``span`` is the length of the runs that keep a
    fingerprint; templates of one span share a table of fingerprints.
    """

    def __init__(self, templates: dict[str, str], coverage: float):
        self.names = list(templates)
        parts = [_words(text) for text in templates.values()]
        self.words: list[np.ndarray] = [hashes for _, hashes in parts]
        self.need = [max(1, math.ceil(coverage * len(w))) for w in self.words]
        self.reach = [max(2, len(w) // 8) for w in self.words]
        self.span = [max(1, -(-need // (len(w) - need + 1))) for w, need in zip(self.words, self.need)]
        self.kinds = np.unique(np.concatenate([*self.words, np.zeros(0, np.uint64)]))
        self.has = [np.append(np.isin(self.kinds, w), False) for w in self.words]
        # Per span: fingerprints in order, with the template and the place of each.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for span in sorted(set(self.span)):
            prints, owner, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for t, (words, hashes) in enumerate(parts):
                if self.span[t] == span:
                    at, found = winnow(words, hashes, *split_span(span))
                    prints.append(found)
                    place.append(at)
                    owner.append(np.full(len(at), t))
            keys = np.concatenate(prints)
            order = np.argsort(keys, kind="stable")
            self.tables[span] = keys[order], np.concatenate(owner)[order], np.concatenate(place)[order]

    def hits(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(template, text, diagonal) of shared fingerprints, the diagonal in words of the slice.

        A hit goes on only if the bands beside it hold as many of the template's words as a match needs.
        """
        if not len(self.kinds):
            return
        owners = words.texts()
        kind = np.minimum(np.searchsorted(self.kinds, hashes), len(self.kinds) - 1)
        kind[self.kinds[kind] != hashes] = len(self.kinds)
        for span, (keys, owner, place) in self.tables.items():
            if not len(keys):
                continue
            at, found = winnow(words, hashes, *split_span(span))
            low = np.searchsorted(keys, found, "left")
            equal = np.searchsorted(keys, found, "right") - low
            entry, at = ragged(low, equal), np.repeat(at, equal)
            template, diagonal = owner[entry], at - place[entry]
            for t in np.unique(template).tolist():
                mine = template == t
                text, line, size = owners[at[mine]], diagonal[mine], len(self.words[t])
                counted = np.append(0, np.cumsum(self.has[t][kind], dtype=np.int32))
                first = np.clip(line - 4 * self.reach[t], words.bounds[text], words.bounds[text + 1])
                last = np.clip(line + size + 4 * self.reach[t], words.bounds[text], words.bounds[text + 1])
                full = counted[last] - counted[first] >= self.need[t]
                if full.any():
                    yield t, text[full], line[full]


def align(template: list[int], words: list[int], diagonal: int, band: int) -> tuple[int, int, int]:
    """Best alignment of a template near a diagonal: (matched words, first word, word behind).

    Cells are (template word i, document word i + diagonal + offset) for offsets within the band.
    An equal pair counts 2, any gap or replaced word -1; the document's words before and after the
    match are free. Among equal scores the earlier end wins.
    """
    width = 2 * band + 1
    worst = -(10**9)
    # (score, matches, first document word) of the best path into each cell.
    row = [(0, 0, max(diagonal - band + o, 0)) for o in range(width)]
    for i, word in enumerate(template):
        new = []
        for o in range(width):
            at = i + diagonal - band + o
            score, matched, first = row[o]
            inside = 0 <= at < len(words)
            if inside and words[at] == word:
                best = (score + 2, matched + 1, first if matched else at)
            else:
                best = (score - 1, matched, first)
            if o + 1 < width and row[o + 1][0] - 1 > best[0]:  # template word left out
                best = (row[o + 1][0] - 1, *row[o + 1][1:])
            if o and inside and new[-1][0] - 1 > best[0]:  # document word left out
                best = (new[-1][0] - 1, *new[-1][1:])
            new.append(best)
        row = new
    best, end = (worst, 0, 0), 0
    for o, cell in enumerate(row):
        if cell[0] > best[0]:
            best, end = cell, len(template) + diagonal - band + o
    return best[1], best[2], min(max(end, best[2]), len(words))


def _in_bands(index: Index, t: int, hashes: np.ndarray, diagonals: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(matched words, first word, word behind) of a template in the words of a text, around some diagonals.

    Bands of diagonals are ``4 * reach`` wide and begin every ``2 * reach``; the two bands that hold a
    diagonal are looked at. One is aligned if equal words at enough different places of the template lie in
    it, and so is what a match leaves before and behind.
    """
    words, need, step = index.words[t], index.need[t], 2 * index.reach[t]
    order = np.argsort(words, kind="stable")
    ordered, template = words[order], words.tolist()
    bands = np.unique(diagonals // step)
    for band in np.union1d(bands, bands - 1).tolist():
        begin = band * step
        start, stop = max(begin, 0), max(min(begin + 2 * step + len(words), len(hashes)), 0)
        low = np.searchsorted(ordered, hashes[start:stop], "left")
        equal = np.searchsorted(ordered, hashes[start:stop], "right") - low
        place, at = order[ragged(low, equal)], np.repeat(np.arange(len(low)) + start, equal)
        inside = (at - place >= begin) & (at - place < begin + 2 * step)
        place, at = place[inside], at[inside]
        open_parts = [(start, stop)]
        while open_parts:
            low, high = open_parts.pop()
            if len(np.unique(place[(at >= low) & (at < high)])) < need:
                continue
            matched, first, last = align(template, hashes[low:high].tolist(), begin + step - low, step)
            if matched >= need:
                yield matched, low + first, low + last
                open_parts += [(low, low + first), (low + last, high)]


def matches(index: Index, hashes: np.ndarray, hits: list[tuple[int, np.ndarray]]) -> list[tuple]:
    """(template, matched, first word, word behind) in the words of a text at (template, diagonals), without
    those inside a longer match and those that share half their words with a longer one of their template."""
    out = {(-matched, a, b, t) for t, lines in hits for matched, a, b in _in_bands(index, t, hashes, lines)}
    kept: list[tuple] = []
    for negated, a, b, t in sorted(out):
        if not any(
            (c <= a and b <= d) or (u == t and 2 * (min(b, d) - max(a, c)) >= b - a) for u, _, c, d in kept
        ):
            kept.append((t, -negated, a, b))
    return sorted(kept, key=lambda m: (m[2], m[3], m[0]))


def scan(
    df: DataFrame, keep: list[str], text: str = "text", templates: dict[str, str] | None = None,
    coverage: float = 0.8,
) -> DataFrame:
    """A row per match: ``keep``, license, words matched and in the template, coverage and span.

    ``start`` and ``end`` are code points of the text, the end exclusive. Matches cover at least
    ``coverage`` of the template's words; a match inside a longer one (or an equal one of an earlier
    template) is left out. Rows are independent: null and empty texts have no matches, null keys
    and repeated rows are scanned like any other, and texts of any length are scanned whole. An empty
    table gives no rows. ``keep`` may not hold the names of the new columns.
    """
    clash = {"license", "matched", "template_words", "coverage", "start", "end", "_text"} & set(keep)
    if clash:
        raise ValueError(f"columns of the result cannot be kept: {sorted(clash)}")
    index = Index(TEMPLATES if templates is None else templates, coverage)
    picked = df.select(*keep, df[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "_text"):
                words = Words(LOWER[data], offsets, ALNUM)
                hashes = words.hashes()
                possible: dict[int, list[tuple[int, np.ndarray]]] = {}
                for t, texts, lines in index.hits(words, hashes):
                    for i in np.unique(texts).tolist():
                        possible.setdefault(i, []).append((t, lines[texts == i] - words.bounds[i]))
                out = []
                for i, some in sorted(possible.items()):
                    a, b = words.bounds[i], words.bounds[i + 1]
                    for t, matched, first, last in matches(index, hashes[a:b], some):
                        begin, end = words.starts[a + first], words.ends[a + last - 1]
                        before = data[offsets[i] : begin].tobytes().decode("utf-8", "replace")
                        inside = data[begin:end].tobytes().decode("utf-8", "replace")
                        size = len(index.words[t])
                        out.append(
                            (i, index.names[t], matched, size, matched / size, len(before), len(before) + len(inside))
                        )
                taken = rows.take(pa.array([o[0] for o in out], pa.int64()))
                columns = list(zip(*(o[1:] for o in out))) or [()] * 6
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(taken.column(c) for c in range(len(keep))),
                        *(pa.array(list(v), k) for v, k in zip(columns, kinds)),
                    ],
                    [*keep, "license", "matched", "template_words", "coverage", "start", "end"],
                )

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "_text"]
    schema += ["license string, matched long, template_words long, coverage double, start long, end long"]
    return picked.mapInArrow(run, ", ".join(schema))
