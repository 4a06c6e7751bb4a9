"""Licence scans: stretches of a text compared with licence templates by the Dice coefficient over word bigrams.

Text is normalised to runs of ASCII letters and digits in lower case, so line breaks and comment signs play no part, and every window of
neighbouring words is a stretch. Bigrams count as often as they occur: with a bigrams in a window and b in a template, 2 * common >= t * (a + b)
can only hold if a lies between b * t / (2 - t) and b * (2 - t) / t, and if common >= b * t / (2 - t). The first bound says how long windows
are, the second which templates a text is looked through for at all, and from which of its words on.

A best window starts and ends with a bigram that it has in common with the template, for a shorter one without it would be
better; so only such windows are looked at. Within a window a bigram counts if its c-th last occurrence before it lies outside, c being how often the
template has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylog.llm.common import MULTIPLIER, WordHashes, arrow_table, bounded_batches, free_name, mix, small_pieces

WORD = re.compile(rb"[a-z0-9]+")
#: The least Dice coefficient, as a fraction of whole numbers.
LEAST = (4, 5)
# fixed value: the disclaimer that the BSD licences share
BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# fixed values: notices by which texts say what licence they are under, and texts of the short licences
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd-2-clause": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause": "Licensed under the BSD 3-Clause License.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "bsd-3-clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. "
    ) + BSD_DISCLAIMER,
    "bsd-2-clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
    ) + BSD_DISCLAIMER,
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
}


def bigrams(text: str, hashes: WordHashes) -> np.ndarray:
    """Hashes of the pairs of neighbouring words of the normalised text, in order."""
    words = hashes.of(WORD.findall(text.encode().lower()))
    return mix(words[:-1] * MULTIPLIER + words[1:]) if len(words) > 1 else words[:0]


class Match(NamedTuple):
    """A template, its best coefficient, and the first word and number of words of the first window that has it (the shortest of those)."""

    licence: str
    dice: float
    start: int
    words: int


class Matcher:
    """Templates by their bigrams, and what a text has of them."""

    def __init__(self, templates: dict[str, str], least: tuple[int, int] = LEAST):
        self.hashes, (self.over, self.under) = WordHashes(), least
        self.names = sorted(templates)
        lists = [bigrams(templates[n], self.hashes) for n in self.names]
        if not all(len(x) for x in lists):
            raise ValueError("a template needs two words")
        self.known = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
        self.counts = np.array([np.bincount(np.searchsorted(self.known, x), minlength=len(self.known)) for x in lists], np.int64).reshape(len(lists), len(self.known))
        self.sizes = self.counts.sum(axis=1)
        t, u = self.over, self.under
        self.needed = -(-self.sizes * t // (2 * u - t))
        self.most = self.sizes * (2 * u - t) // t

    def found(self, text: str) -> list[Match]:
        """The best window of each template that some window of the text matches."""
        own = bigrams(text, self.hashes)
        if not len(own) or not len(self.known):
            return []
        which = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        places = np.flatnonzero(self.known[which] == own)
        which = which[places]
        have = np.bincount(which, minlength=len(self.known))
        out = []
        for c in np.flatnonzero(np.minimum(self.counts, have).sum(axis=1) >= self.needed):
            hits = self.counts[c][which] > 0
            if (best := self._best(int(c), places[hits], which[hits])) is not None:
                out.append(best)
        return out

    def _best(self, c: int, places: np.ndarray, which: np.ndarray) -> Match | None:
        size, needed, counts = int(self.sizes[c]), int(self.needed[c]), self.counts[c][which]
        # of each hit, the place of the hit of the same bigram that many before it as the template has of it
        order = np.argsort(which, kind="stable")
        back = np.arange(len(order)) - counts[order]
        inside = back >= np.searchsorted(which[order], which[order])
        before = np.full(len(order), -1, np.int64)
        before[order[inside]] = places[order[back[inside]]]
        ends = np.searchsorted(places, places + self.most[c])
        best = None
        for i in np.flatnonzero(ends - np.arange(len(places)) >= needed):
            common = np.cumsum(before[i : ends[i]] < places[i])
            if common[-1] < needed:
                continue
            length = places[i : ends[i]] - places[i] + 1
            dice = 2.0 * common / (length + size)
            j = int(np.argmax(dice))
            if 2 * self.under * common[j] >= self.over * (length[j] + size) and (best is None or dice[j] > best.dice):
                best = Match(self.names[c], float(dice[j]), int(places[i]), int(length[j]) + 1)
                if best.dice == 1.0:
                    break
        return best


FOUND = pa.schema([("licence", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("words", pa.int64())])


def licence_matches(docs: DataFrame, templates: dict[str, str] | None = None, least: tuple[int, int] = LEAST, text: str = "text", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carried`` columns, ``licence``, ``dice``, ``start`` and ``words``: a row for each document and template that a window of its words matches.

    ``dice`` is the best coefficient, ``start`` (from 0) and ``words`` the first window that has it, in words of the normalised text; of those that start
    together the shortest. ``templates`` are names and texts, shipped to all tasks; ``least`` is the least coefficient as (numerator, denominator). Null and
    empty texts, and those of one word, match nothing; equal rows give equal rows; an empty table gives none. A text is read whole, in time
    proportional to its length and the templates' sizes. Other columns are not looked at.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(Matcher(TEMPLATES if templates is None else templates, least))  # of the templates' size
    whole = free_name(docs, "_text")
    chosen = docs.select(*carried, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(whole))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != whole] + ["licence string", "dice double", "start long", "words long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in small_pieces(batches, whole):
            found = [own.found(t) for t in batch.column(whole).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
            kept = batch.select([n for n in batch.schema.names if n != whole]).take(at)
            new = arrow_table({name: [getattr(m, name) for f in found for m in f] for name in Match._fields}, FOUND)
            yield pa.RecordBatch.from_arrays(kept.columns + new.columns, schema=pa.schema([*kept.schema, *FOUND]))

    return chosen.mapInArrow(run, schema)
