"""License scans by conditional compression.

A candidate block is what stands around a licensing word, whatever the lines, as far
as a template may reach from there. Each block, its lines joined (line feeds, indents
and comment marks are no words), is compressed on its own and with each template as
a raw zstandard dictionary. Where that saves bytes the exact wording decides: a place
is a stretch that holds the template's words in order, with at most ``MISSING`` of
them missing, added or replaced and every word that tells the license from its
versions (numbers and codes) present. Places are ranked by the bytes that their
template saves on their own text; of those that overlap, the first is the license
that stands there. (Compressed with all around it, up to 450 words, a short notice
can save nothing: on 0.1 GB this lost 101 of 1609.)

Defined cases: null and empty texts have no blocks; a tie in size goes to the
template with fewer differences, then to the name that sorts first; equal texts
get equal rows; each place in a block is a row, so a block with several licenses
has several; very long texts are read through block by block, as a whole; null
doc_ids stay null; other columns don't matter. No step shuffles, and a worker holds one
batch.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Share of a template's words that a block may lack or replace.
MISSING = 0.15

# Usual wordings of public licenses.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
}

_ANCHOR = r"(?i)licen[cs]|copyright|redistribut|permission|waived|cc0"
_anchor = re.compile(_ANCHOR)
_WORD = re.compile(r"[^\W_]+")
#: Line feeds with the blanks and comment marks around them.
_FOLD = re.compile(r"[^\S\n]*\n(?:[^\w\"'(]|_)*")
#: Words that must not differ: numbers and the short codes of license families.
_CODES = frozenset("mit apache gnu gpl lgpl agpl lesser library affero bsd mozilla cc cc0 by sa nc nd attribution sharealike noncommercial noderivatives".split())


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@functools.lru_cache(maxsize=1)
def _compressors():
    """(license, words, compressor) of each template, and the plain compressor."""
    made = []
    for name, texts in sorted(TEMPLATES.items()):
        for text in texts:
            prefix = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.append((name, words(text), zstandard.ZstdCompressor(level=19, dict_data=prefix, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return made, zstandard.ZstdCompressor(level=19, write_content_size=False, write_checksum=False)


#: Words that a block may reach from a licensing word: the longest template with all it may have between.
REACH = max(len(words(t)) + int(MISSING * len(words(t))) for texts in TEMPLATES.values() for t in texts)


def blocks(text: str) -> Iterator[list[tuple[str, int, int]]]:
    """Candidate stretches of a text, apart from each other, as (word, start, stop)."""
    block: list[tuple[str, int, int]] = []
    since = None  # words after the last licensing word
    for m in _WORD.finditer(text):
        block.append((m[0].lower(), m.start(), m.end()))
        if _anchor.search(m[0]):
            block, since = block if since is not None else block[-REACH - 1 :], 0
        elif since is not None:
            since += 1
            if since == 2 * REACH:
                yield block[:-REACH]
                block, since = block[-REACH:], None
        elif len(block) > 2 * REACH:
            block = block[-REACH:]
    if since is not None:
        yield block


def places(template: list[str], said: list[str]) -> list[tuple[int, int, int]]:
    """(differences, first word, word after the last) of a template's places in a block,
    apart from each other: fewest differences first, then the shortest. A word that is
    missing, added or replaced is one difference."""
    n, most = len(template), int(MISSING * len(template))
    price = [most + 1 if w in _CODES or w.isdigit() else 1 for w in template]
    there = set(said)
    if sum(p for w, p in zip(template, price, strict=True) if w not in there) > most:
        return []
    # by number of template words: fewest differences of a stretch that ends here, and less its start
    best = [(0, 0)]
    for p in price:
        best.append((best[-1][0] + p, 0))
    ends = []
    for j, w in enumerate(said):
        extra = most + 1 if w in _CODES else 1
        corner, best[0] = (0, -j), (0, -j - 1)
        for i in range(1, n + 1):
            other = 0 if template[i - 1] == w else max(price[i - 1], extra)
            cost, start = min((best[i][0] + extra, best[i][1]), (best[i - 1][0] + price[i - 1], best[i - 1][1]), (corner[0] + other, corner[1]))
            corner, best[i] = best[i], (cost, start)
        if best[n][0] <= most:
            ends.append((best[n][0], j + 1 + best[n][1], -best[n][1], j + 1))
    out: list[tuple[int, int, int]] = []
    for cost, _, a, b in sorted(ends):
        if all(b <= x or y <= a for _, x, y in out):
            out.append((cost, a, b))
    return out


def differences(template: list[str], block: list[str]) -> tuple[list[str], list[str]]:
    """Template words that the block lacks, and words that stand between matched ones
    in their place, by a longest common subsequence (its last, tightest place)."""
    n, m = len(template), len(block)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if template[i] == block[j] else max(below[j], row[j + 1])
    i = j = 0
    lacking, extra, pending, begun = [], [], [], False
    while i < n and j < m:
        if template[i] == block[j]:
            extra += pending if begun else []
            pending, begun = [], True
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            lacking.append(template[i])
            i += 1
        else:
            pending.append(block[j])
            j += 1
    return lacking + template[i:], extra


def judge_block(text: str, block: list[tuple[str, int, int]]) -> list[tuple]:
    """(start, stop, license, bytes saved, words lacking, words extra) of each license
    that stands in a block, in order of place."""
    made, plain = _compressors()
    said = [w for w, _, _ in block]

    def raw(a: int, b: int) -> bytes:
        return _FOLD.sub(" ", text[block[a][1] : block[b - 1][2]]).lower().encode("utf-8", "surrogatepass")

    anchors = [k for k, w in enumerate(said) if _anchor.search(w)]
    alone: dict[tuple[int, int], int] = {}
    found = []
    for name, template, compressor in made:
        reach = len(template) + int(MISSING * len(template))
        around: list[list[int]] = []  # stretches in which the template saves bytes
        for k in anchors:
            a, b = max(0, k - reach + 1), min(len(said), k + reach)
            text_of = raw(a, b)
            if (a, b) not in alone:
                alone[a, b] = len(plain.compress(text_of))
            if len(compressor.compress(text_of)) >= alone[a, b]:
                continue
            if around and a <= around[-1][1]:
                around[-1][1] = b
            else:
                around.append([a, b])
        for first, last in around:
            for cost, a, b in places(template, said[first:last]):
                own = raw(first + a, first + b)
                found.append((len(compressor.compress(own)) - len(plain.compress(own)), cost, name, first + a, first + b, template))
    out: list[tuple] = []
    for size, _, name, a, b, template in sorted(found):
        if all(b <= x or y <= a for x, y, *_ in out):
            out.append((a, b, name, -size, *differences(template, said[a:b])))
    return [(block[a][1], block[b - 1][2], *rest) for a, b, *rest in sorted(out)]


RESULT = "doc_id long, block int, start long, stop long, license string, bytes_saved long, n_lacking long, n_extra long, differences string"


def scan(docs: DataFrame) -> DataFrame:
    """One row per license and place (code points; stop is exclusive): see RESULT."""

    def run(batches):
        names = [c.split()[0] for c in RESULT.split(", ")]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            some = batch.filter(pc.match_substring_regex(batch.column(1).fill_null(""), _ANCHOR))
            rows = []
            for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                for k, block in enumerate(blocks(text)):
                    for start, stop, name, saved, lacking, extra in judge_block(text, block):
                        rows.append((doc, k, start, stop, name, saved, len(lacking), len(extra), " ".join([f"-{w}" for w in lacking] + [f"+{w}" for w in extra])))
            cols = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
