"""License scans: winnowed fingerprints pick templates, banded alignment measures them.

Fingerprints are hashes of 3 words, the least of every 3 in a row kept, so any
5 words in common share one. Templates' fingerprints form an inverted index;
each hit of a text proposes a template and a diagonal, hits close together make
one candidate, and a banded global-in-template alignment of words gives the
share of the template that the text has, and where.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames, textkit

GRAM, WINNOW, BAND = 3, 3, 8
#: The least share of a template's words that is reported.
LEAST_COVERAGE = 0.6

_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
        f"You should have received a copy of the {name} along with this program. If not, see https://www.gnu.org/licenses/."
    )


# Whole texts of short public licenses, the notices that longer ones
# ask for, and one-sentence references, by SPDX identifier.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "AGPL-3.0-notice": _gnu("GNU Affero General Public License", "3"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": _BSD + _DISCLAIMER,
    "BSD-3-Clause": _BSD + _NAMES + _DISCLAIMER,
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": _gnu("GNU General Public License", "2"),
    "GPL-3.0-notice": _gnu("GNU General Public License", "3"),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-3.0-notice": _gnu("GNU Lesser General Public License", "3"),
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+(?:[.-][0-9a-z]+)*")


def _words(text: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
    found = list(_WORD.finditer(text.translate(textkit._LOWER)))
    return [m[0] for m in found], [m.span() for m in found]


def _hashes(words: list[bytes]) -> np.ndarray:
    return textkit.words(words).hash if words else np.zeros(0, np.uint64)


def winnow(h: np.ndarray) -> np.ndarray:
    """Places of the fingerprints of a sequence of word hashes: the least 3-gram of each window, the last of equals."""
    g = textkit.windows(h, GRAM)
    if len(g) <= WINNOW:
        return np.array([len(g) - 1 - int(np.argmin(g[::-1]))]) if len(g) else np.zeros(0, np.int64)
    v = np.lib.stride_tricks.sliding_window_view(g[::-1], WINNOW)
    return np.unique(len(g) - 1 - (np.arange(len(v)) + v.argmin(1)))


def align(template: list, text: list, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, last + 1 of the text's words) of the best banded alignment around ``diagonal`` (text minus template place).

    Of alignments with as many matches, the one over the fewest words of the
    text, then the first of them. A path carries its matches and its first
    word; of paths with as many matches the one that began later can only end
    in a narrower span, so it stays, and each match is weighed as the last one.
    """
    width, lo, best = 2 * band + 1, diagonal - band, (0, 0, 0)
    score = [(0, -1)] * (width + 1)
    for i, word in enumerate(template):
        new = [(0, -1)] * (width + 1)
        for b in range(width):
            j = i + lo + b
            top = max(score[b + 1], new[b - 1]) if b else score[b + 1]  # a word of the template, or of the text, is left out
            if 0 <= j < len(text) and text[j] == word:
                m, first = score[b]
                own = (m + 1, first if m else j)
                best = max(best, (own[0], own[1] - j, -j))
                top = max(top, own)
            new[b] = top
        score = new
    m, span, last = best
    return (m, span - last, 1 - last) if m else (0, -1, -1)


class LicenseIndex:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [_words(t.encode())[0] for t in templates.values()]
        entries: dict[int, list] = {}
        for k, w in enumerate(self.words):
            g = textkit.windows(_hashes(w), GRAM)
            for at, x in enumerate(g.tolist()):  # all of them, so that a text's winnowed ones are met
                entries.setdefault(x, []).append((k, at))
        self.entries, self.grams = entries, np.array(sorted(entries), np.uint64)

    def scan(self, text: bytes) -> list[tuple]:
        """(template, coverage, start, end) by place, start and end in code points; overlapping finds of one template are one."""
        words, spans = _words(text)
        g = textkit.windows(_hashes(words), GRAM)
        if not len(g):
            return []
        hit = np.isin(g, self.grams)
        if not hit.any():
            return []
        places = winnow(_hashes(words))
        near: dict[tuple, int] = {}
        for p in places[hit[places]].tolist():
            for k, at in self.entries[int(g[p])]:
                near.setdefault((k, (p - at) // BAND), p - at)
        found = []
        for (k, _), diagonal in sorted(near.items()):
            m, a, b = align(self.words[k], words, diagonal)
            if m >= LEAST_COVERAGE * len(self.words[k]):
                found.append((-m, k, a, b))
        out, taken = [], {}
        for m, k, a, b in sorted(found, key=lambda x: (x[0], x[3] - x[2], x)):
            if all(b <= x or a >= y for x, y in taken.get(k, [])):
                taken.setdefault(k, []).append((a, b))
                s, e = spans[a][0], spans[b - 1][1]
                out.append((len(text[:s].decode()), len(text[:e].decode()), self.names[k], -m / len(self.words[k])))
        return [(k, c, s, e) for s, e, k, c in sorted(out)]


@lru_cache(maxsize=4)
def _index(templates: tuple) -> LicenseIndex:
    return LicenseIndex(dict(templates))


def scan(df: DataFrame, keep: list[str], text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """``keep`` of each row beside ``licenses``: array<struct<template, coverage, start, end>>.

    Null and empty texts have none; whole texts of any length are scanned, and
    rows come out one for one, an empty table as an empty one. Of equal
    alignments the narrowest span, then the first, is reported. A ``keep``
    column named licenses raises.
    """
    held = tuple((templates or TEMPLATES).items())

    def run(batch: pa.RecordBatch) -> dict:
        index, out = _index(held), []
        for _, texts in textkit.text_slices(batch, text):
            out += [[dict(zip(("template", "coverage", "start", "end"), x)) for x in index.scan(t)] for t in texts]
        return {"licenses": pa.array(out, pa.list_(pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])))}

    return frames.arrow_map(df.select(*dict.fromkeys([*keep, text])), run, keep, "licenses array<struct<template: string, coverage: double, start: int, end: int>>")
