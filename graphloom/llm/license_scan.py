"""Licence scans: normalised passages against licence templates by the Dice coefficient of word bigrams.

Passages are the lines of a text, its blocks of lines without a blank one (lines of
comment marks are blank), the text as a whole, and, so that neither wrapping nor
surroundings matter, all windows of words within a template's size bounds. With a
threshold t, a template of b bigrams can only match a passage of a bigrams if a lies
between b t / (2 - t) and b (2 - t) / t; other templates are not compared. Bigrams are
counted with their repetitions.

A name that others continue after a dash ("BSD" of "BSD-2-Clause") is a general one: it
stands for wording that they share, and gives way to them where they match.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import byte_values, sliced, without

THRESHOLD = 0.8

# Paragraphs that licences share.
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT_HEAD = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_END = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
_APACHE_END = "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GPL3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_GPL3_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

# Licence notices, grants and whole short licences, by SPDX name (and one for none).
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        _MIT_HEAD,
        f"{_MIT_HEAD} {_MIT_END}",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        _APACHE,
        f"{_APACHE} {_APACHE_END}",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        _GPL3,
        f"{_GPL3} {_GPL3_END}",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "BSD": (_BSD_HEAD,),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        f"{_BSD_HEAD} {_BSD_TWO} {_BSD_END}",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        f"{_BSD_HEAD} {_BSD_TWO} {_BSD_THIRD} {_BSD_END}",
    ),
    "ISC": (_ISC, f"{_ISC} {_ISC_END}"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright to this work to the public domain worldwide.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "none": ("All rights reserved.",),
}

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_MARKS = re.compile(r"[\s/*#;%!>|-]*")
_NOTICE = re.compile(r"^\W*(?:copyright|\(c\)|©)[^\n]*?(?=all rights reserved|$)", re.I | re.M)


def normalised(text: str) -> list[str]:
    """Words in lower case, without copyright holders' lines; spellings of licence are one."""
    text = _NOTICE.sub("", text).lower().replace("licence", "license")
    return _WORD.findall(text)


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


def placed(text: str) -> tuple[list[str], list[int], list[int]]:
    """``normalised`` words of a text with their starts and ends in it."""
    words, starts, ends = [], [], []
    at = 0
    for notice in [*_NOTICE.finditer(text), None]:
        for m in _WORD.finditer(text, at, notice.start() if notice else len(text)):
            words.append(m.group().lower().replace("licence", "license"))
            starts.append(m.start())
            ends.append(m.end())
        at = notice.end() if notice else at
    return words, starts, ends


def _tells(name: str, other: str) -> bool:
    """Whether ``name`` says all that ``other`` does: it is the same or continues it after a dash."""
    return name == other or name.startswith(f"{other}-")


class Matcher:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.known = [(name, bigrams(normalised(x))) for name, texts in templates.items() for x in texts]
        slack = 1e-9  # a size exactly at a bound counts
        self.bounds = [(b.total() * threshold / (2 - threshold) - slack, b.total() * (2 - threshold) / threshold + slack) for _, b in self.known]
        self.longest = max((hi for _, hi in self.bounds), default=0)
        self.sizes = [b.total() for _, b in self.known]
        self.general = {n for n, _ in self.known if any(_tells(m, n) and m != n for m, _ in self.known)}
        self.where: dict[tuple[str, str], list[int]] = {}
        for k, (_, b) in enumerate(self.known):
            for g in b:
                self.where.setdefault(g, []).append(k)
        # Bigrams that the smallest matching window shares with a template, 2 s >= t (n + b) and n >= s.
        self.shared = [math.ceil(b.total() * threshold / (2 - threshold) - slack) for _, b in self.known]

    def match(self, passage: str) -> tuple[str, float] | None:
        """Best template and its coefficient; ties go to the first."""
        words = normalised(passage)
        n = len(words) - 1
        if n < 1 or n > self.longest:
            return None
        # For each template the passage's bigrams that it has: no fewer than those in common.
        tally = Counter(k for g in zip(words, words[1:]) for k in self.where.get(g, ()))
        own, best = None, None
        for k in sorted(tally):
            (name, b), (lo, hi) = self.known[k], self.bounds[k]
            if lo <= n <= hi and 2 * tally[k] >= self.threshold * (n + self.sizes[k]) - 1e-9:
                own = own or bigrams(words)
                if (d := dice(own, b)) >= self.threshold and (best is None or d > best[1]):
                    best = name, d
        return best

    def windows(self, text: str) -> list[tuple[int, int, str, float]]:
        """The best windows (start, end, template, coefficient) of each template that overlap no better one of it.

        A best window begins and ends with bigrams of the template, so only those are tried. Of
        those with one start, a longer one that is no better is never taken: it overlaps what the
        shorter one does.
        """
        words, starts, ends = placed(text)
        at: dict[int, list[int]] = {}
        pairs = list(zip(words, words[1:]))
        for i, g in enumerate(pairs):
            for k in self.where.get(g, ()):
                at.setdefault(k, []).append(i)
        out = []
        for k, places in at.items():
            (name, b), (lo, hi), least = self.known[k], self.bounds[k], max(self.shared[k], 1)
            size, found = self.sizes[k], []
            for i in range(len(places) - least + 1):
                if places[i + least - 1] - places[i] + 1 > hi:
                    continue
                left, same, top = dict(b), 0, 0.0
                for p in places[i:]:
                    n = p - places[i] + 1
                    if n > hi:
                        break
                    if left[pairs[p]] > 0:
                        left[pairs[p]] -= 1
                        same += 1
                        if n >= lo and (d := 2 * same / (n + size)) >= self.threshold and d > top:
                            found.append((d, places[i], p))
                            top = d
            taken: list[tuple[int, int]] = []
            for d, i, p in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
                if (z := bisect_right(taken, (i, p))) and taken[z - 1][1] + 1 >= i or z < len(taken) and taken[z][0] <= p + 1:
                    continue
                taken.insert(z, (i, p))
                out.append((starts[i], ends[p + 1], name, d))
        return out

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """Matching passages (start, end, template, coefficient); none inside a larger one with the same template."""
        found, at, block = [], 0, None
        lines = text.split("\n")
        spans = []
        for line in [*lines, ""]:
            end = at + len(line)
            if not _MARKS.fullmatch(line):
                spans.append((at, end))
                block = (block[0] if block else at, end, block[2] + 1 if block else 1)
            elif block:
                spans += [block[:2]] * (block[2] > 1)
                block = None
            at = end + 1
        if len(lines) > 1:
            spans.append((0, len(text)))
        for a, b in sorted(set(spans), key=lambda s: (s[0] - s[1], s)):
            if (m := self.match(text[a:b])) and not any(x <= a and b <= y and m[0] == z for x, y, z, _ in found):
                found.append((a, b, *m))
        # Windows tell what lines, blocks and the whole do not; the better of two that overlap stays. General names come last.
        last = [f for f in found if f[2] in self.general]
        found = [f for f in found if f[2] not in self.general]
        windows = sorted(self.windows(text), key=lambda w: (-w[3], w[0] - w[1], w))
        for a, b, name, d in [w for w in windows if w[2] not in self.general] + last + [w for w in windows if w[2] in self.general]:
            if not any(x < b and a < y and (_tells(z, name) or c >= d) for x, y, z, c in found):
                found.append((a, b, name, d))
        return sorted(found)


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but ``text``, then ``license``, ``coefficient`` (the best match's), ``n_matches``, ``matches``.

    ``matches`` lists name:start:end (code points) by start, comma-joined. Without a
    match, with a null or an empty text: null, 0.0, 0, empty. Row by row, so repeated
    rows stay; result columns replace columns of ``docs`` with the same names.
    """
    made = [T.StructField("license", T.StringType()), T.StructField("coefficient", T.DoubleType()), T.StructField("n_matches", T.LongType()), T.StructField("matches", T.StringType())]
    names = without(docs, text, *(f.name for f in made))
    schema = T.StructType([*(docs.schema[c] for c in names), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for b in sliced(batches, 256):
            all_found = [matcher.scan((x or b"").decode("utf-8", "replace")) for x in byte_values(b, text)]
            best = [max(f, key=lambda m: (m[3], -m[0]), default=(0, 0, None, 0.0)) for f in all_found]
            arrays = [
                pa.array([m[2] for m in best], pa.string()),
                pa.array([m[3] for m in best], pa.float64()),
                pa.array([len(f) for f in all_found], pa.int64()),
                pa.array([",".join(f"{n}:{s}:{e}" for s, e, n, _ in f) for f in all_found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), *arrays], schema.names)

    return docs.select(*names, text).mapInArrow(run, schema)
