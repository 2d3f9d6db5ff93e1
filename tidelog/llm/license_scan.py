"""Operator 3: licence scan by conditional compression.

Documents with a word that licences use are scanned. A block starts wherever enough of a template's
words lie close together, however the lines are wrapped and whatever stands before; the template's
words are aligned to it, in order, up to a share of differences, which are reported. The block, from
the first word found, is compressed once plainly and once with the template as raw zstandard
dictionary, both cut to the template's length; without a saving there is no finding. Versions, years
and names are slots of a template, not wording; the holder of a copyright is a slot that takes whole
names, up to the end of the sentence.

Defined results: null or empty text has no finding; a document has a row for each finding, repeated
rows each; of overlapping findings the one that matches more words, less those it misses, stays, of
equal ones the one with the larger saving (savings of texts of different length don't compare), then
the earlier start and template; an empty table gives an empty result; other columns, whatever their
names, are not read.
Offsets are code points, end exclusive.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of

ANCHOR = r"(?i)licen[cs]|copyright|\(c\)|©|spdx|permission|redistribut|warrant|public\W+domain|all\W+rights\W+reserved|creative\W+commons|\bcc\W*(?:by|0)"

#: Public wordings of licence notices. {} is a slot for a version, year or name,
#: {holder} one for the years and names of a copyright's holders, of any number of words.
TEMPLATES = (
    ("MIT-line", "Released under the MIT License."),
    ("Apache-line", "Licensed under the Apache License, Version {}."),
    ("GPL-line", "This work is licensed under the GNU General Public License, version {}."),
    ("LGPL-line", "This work is licensed under the GNU Lesser General Public License, version {}."),
    ("AGPL-line", "This work is licensed under the GNU Affero General Public License, version {}."),
    ("BSD-line", "Released under the BSD License."),
    ("CC-BY-line", "Licensed under CC BY {}."),
    ("CC-BY-SA-line", "Licensed under CC BY-SA {}."),
    ("CC-BY-NC-line", "Licensed under CC BY-NC {}."),
    ("CC-BY-ND-line", "Licensed under CC BY-ND {}."),
    ("CC-BY-NC-SA-line", "Licensed under CC BY-NC-SA {}."),
    ("CC-BY-NC-ND-line", "Licensed under CC BY-NC-ND {}."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution {} International License."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike {} International License."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial {} International License."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("SPDX", "SPDX-License-Identifier: {}"),
    ("Public-domain", "This is free and unencumbered software released into the public domain."),
    ("All-rights-reserved", "Copyright {holder}. All rights reserved."),
    ("All-rights-reserved", "(c) {holder}. All rights reserved."),
    ("All-rights-reserved", "© {holder}. All rights reserved."),
    ("All-rights-reserved", "All rights reserved."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MIT-permission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org'),
    ("ISC-permission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("Apache-2.0", 'Licensed under the Apache License, Version {} (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. {}. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)

WORD = re.compile(r"©|[^\W_]+(?:\.[0-9]+)*")
SLOT = re.compile(r"\{\}|\{holder\}")
#: The identifiers after an SPDX tag, joined as SPDX has it; the finding's name holds them.
SPDX_ID = r"\(*(?:[A-Za-z0-9][A-Za-z0-9.+:-]*[A-Za-z0-9+]|[A-Za-z0-9])\)*"
SPDX = re.compile(rf"(?i)SPDX-License-Identifier:[ \t]*({SPDX_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{SPDX_ID})*)")
#: A line's end, with the marks of a comment that may begin the next one.
WRAP = re.compile(r"\s*\n[\s*#/;%!-]*")
#: An empty line ends a sentence, or a full stop before a capital, unless it follows a number, an
#: initial or one of these words.
ABBREVIATED = frozenset("inc ltd co corp llc plc bros jr sr dr mr mrs ms prof st al etc dept univ assn no vs".split())
#: Least share of a template's words found, most words between them per template word.
FOUND, EXTRA, LEVEL = 0.9, 0.15, 3


def lowered(text: str) -> str:
    """Lower case, letter by letter where a letter would become two, so that offsets hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c in text for x in [c.lower()])


def ends_sentence(text: str, a: re.Match, b: re.Match) -> bool:
    """Whether a sentence ends between the neighbouring words a and b."""
    gap = text[a.end() : b.start()]
    if re.search(r"\n\s*\n", gap):
        return True
    word = a[0].lower()
    return bool(re.search(r"[.!?]\W*\s", gap)) and text[b.start()].isupper() and not (word in ABBREVIATED or len(word) == 1 or word[0].isdigit())


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        import zstandard as z

        self.names, self.want, self.size, self.holder, self.slot_last = [], [], [], [], []
        self.need, self.extra, self.plain, self.primed = [], [], z.ZstdCompressor(level=LEVEL), []
        for name, text in templates:
            words = [w for part in SLOT.split(text.lower()) for w in (*WORD.findall(part), None)][:-1]
            want = [w for w in words if w]
            head, slot, _ = text.partition("{holder}")
            self.names.append(name)
            self.want.append(want)
            self.size.append(len(text) + 40)
            self.holder.append(len(WORD.findall(head)) if slot else None)
            self.slot_last.append(words[-1] is None)
            self.need.append(math.ceil(FOUND * len(want)))
            self.extra.append(int((words.count(None) - bool(slot)) * 4 + EXTRA * len(want)))
            held = z.ZstdCompressionDict(SLOT.sub("{}", text).lower().encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
            self.primed.append(z.ZstdCompressor(level=LEVEL, dict_data=held))
        self.count = [Counter(w) for w in self.want]
        self.known = {w: i for i, w in enumerate(dict.fromkeys(w for x in self.want for w in x), 1)}
        #: Which templates have a word; row 0 is for all other words.
        self.has = np.array([[False] * len(self.want), *([w in c for c in self.count] for w in self.known)])

    def areas(self, have: list[str]) -> Iterator[tuple[int, int, int]]:
        """(template, start, end) of the runs of words that hold enough of a template's words."""
        seen = np.array([self.known.get(w, 0) for w in have])
        n, upto = len(have), np.zeros((len(have) + 1, len(self.want)), np.int32)
        np.cumsum(self.has[seen], 0, out=upto[1:])
        for k in np.flatnonzero(upto[-1] >= self.need):
            if self.holder[k] is not None:
                runs = [(0, n)]
            else:
                width = min(n, len(self.want[k]) + self.extra[k])
                starts = np.flatnonzero(upto[width:, k] - upto[: n + 1 - width, k] >= self.need[k])
                cuts = np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1) if len(starts) else []
                runs = [(int(c[0]), int(c[-1]) + width) for c in cuts]
            for lo, hi in runs:
                if (Counter(have[lo:hi]) & self.count[k]).total() >= self.need[k]:
                    yield int(k), lo, hi

    def aligned(self, k: int, text: str, at: list[re.Match], have: list[str], lo: int, hi: int) -> tuple[list[tuple], set[tuple[int, int]]]:
        """The places of template k in have[lo:hi], and the gaps between them to look at again:
        (first, last, missing, added, words found) and (start, end).

        A word found counts 2, one missed -2, one added -1, or nothing where the holder's slot is."""
        want, h, n = self.want[k], self.holder[k], hi - lo
        m = len(want)
        # a holder doesn't run over the end of a sentence or of an earlier notice
        stop = [j > 0 and (ends_sentence(text, at[lo + j - 1], at[lo + j]) or have[max(lo, lo + j - m + h) : lo + j] == want[h:]) for j in range(n)] if h is not None else []
        never = -4 * m
        rows = [[0] * (n + 1)]
        for i, w in enumerate(want, 1):
            above, row = rows[-1], [-2 * i]
            for j in range(1, n + 1):
                score = above[j] - 2
                x = never if i == m else (never if stop[j - 1] else row[-1]) if i == h else row[-1] - 1
                if x > score:
                    score = x
                if have[lo + j - 1] == w and above[j - 1] + 2 > score:
                    score = above[j - 1] + 2
                row.append(score)
            rows.append(row)
        least = 2 * self.need[k] - 2 * (m - self.need[k]) - self.extra[k]
        out: list[tuple] = []
        used, tried = bytearray(n), []
        for end in sorted((j for j in range(1, n + 1) if rows[m][j] >= least), key=lambda j: (-rows[m][j], j)):
            i, j, pairs, free = m, end, [], 0
            while i:
                score = rows[i][j]
                into = i == h and j and not stop[j - 1] and score == rows[i][j - 1]
                if not into and j and have[lo + j - 1] == want[i - 1] and score == rows[i - 1][j - 1] + 2:
                    i, j = i - 1, j - 1
                    pairs.append((i, j))
                elif into or j and i < m and i != h and score == rows[i][j - 1] - 1:
                    j, free = j - 1, free + into
                else:
                    i -= 1
            if not pairs or pairs[0][1] != end - 1:
                continue
            first, last = pairs[-1][1], end - 1
            taken, met = {j for _, j in pairs}, {i for i, _ in pairs}
            if len(pairs) < self.need[k] or last + 1 - first - len(pairs) - free > self.extra[k]:
                continue
            if any(used[first : last + 1]):
                tried.append(last)
                continue
            used[first : last + 1] = b"\1" * (last + 1 - first)
            # a last slot takes the next word if that is a number
            more = self.slot_last[k] and lo + last + 1 < len(have) and have[lo + last + 1][0].isdigit()
            added = [have[lo + j] for j in range(first, last + 1 + more) if j not in taken]
            out.append((lo + first, lo + last + more, [w for i, w in enumerate(want) if i not in met], added, len(pairs)))
        # between two places there may be one that was aligned across a neighbour's words
        gaps = set()
        for last in tried:
            if not used[last]:
                a, b = used.rfind(1, 0, last) + 1, used.find(1, last)
                b = b if b >= 0 else n
                if b - a >= self.need[k]:
                    gaps.add((lo + a, lo + b))
        return out, gaps

    def saving(self, k: int, text: str, start: int, end: int) -> int:
        cut = WRAP.sub(" ", text[start : max(end, start + self.size[k])]).lower().encode()
        return len(self.plain.compress(cut)) - len(self.primed[k].compress(cut))

    def scan(self, text: str) -> list[tuple]:
        """(start, end, name, saving, missing, added), by start."""
        at = list(WORD.finditer(lowered(text)))
        have, found = [m[0] for m in at], []
        todo = list(self.areas(have))
        while todo:
            k, lo, hi = todo.pop()
            places, gaps = self.aligned(k, text, at, have, lo, hi)
            todo += [(k, *x) for x in gaps]
            for first, last, missing, added, n in places:
                start, end, name = at[first].start(), at[last].end(), self.names[k]
                if name == "SPDX":
                    if not (m := SPDX.match(text, start)):
                        continue
                    name, end, added = f"SPDX:{m[1]}", m.end(1), [x.lower() for x in WORD.findall(m[1])]
                if (saved := self.saving(k, text, start, end)) > 0:
                    found.append((start, end, name, saved, missing, added, n, k))
        out: list[tuple] = []
        for x in sorted(found, key=lambda x: (len(x[4]) - x[6], -x[3], x[0], x[7])):
            i = bisect.bisect(out, x[0], key=lambda y: y[0])
            if (not i or out[i - 1][1] <= x[0]) and (i == len(out) or x[1] <= out[i][0]):
                out.insert(i, x)
        return [x[:6] for x in out]


def templates_in(folder: str) -> tuple[tuple[str, str], ...]:
    """Templates of the licence texts in a folder of the driver, named by their files, to add to TEMPLATES."""
    from pathlib import Path

    files = sorted(p for p in Path(folder).iterdir() if p.is_file() and not p.is_symlink())
    texts = [(p.name, " ".join(p.read_text(errors="replace").replace("{", "(").replace("}", ")").split())) for p in files]
    return tuple((name, text) for name, text in texts if text)


_scanners: dict[tuple, Scanner] = {}


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, start, end, license, saving, missing, added, exact: one row per finding."""
    ship(docs.sparkSession)
    names = ["doc_id", "start", "end", "license", "saving", "missing", "added"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if templates not in _scanners:
            _scanners[templates] = Scanner(templates)
        scanner = _scanners[templates]
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc, x in zip(b.column("doc_id").to_pylist(), b.column("text")):
                for start, end, name, saved, missing, added in scanner.scan(x.as_py()):
                    for o, v in zip(out, (doc, start, end, name, saved, " ".join(missing), " ".join(added))):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names=names)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).where(F.col("text").rlike(ANCHOR))
    found = rows.mapInArrow(run, "doc_id long, start long, end long, license string, saving long, missing string, added string")
    return found.withColumn("exact", F.col("missing") == "")
