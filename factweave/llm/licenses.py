"""Licence scans by conditional compression (operator 7).

A candidate block, text around words that licences use, is compressed alone and with each template as
raw zstandard dictionary. The templates are ranked by how much that saves, and from the best on the
first is taken whose wording is confirmed: its words are aligned with the block's, nearly all must be
there, and those that tell licences apart (numbers, and the words of MARKS) must all agree.

Defined cases: a null or empty text, and one without a cue, has no blocks. Every row is scanned by
itself, repeated ids included. Of blocks that overlap, the one with more confirmed words is kept, then
the earlier one. Offsets are code points. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import map_batches
from .linedup import aligned

#: Public notices of common licences, as their owners ask for them to be put into works.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "MIT (named)": "Released under the MIT License.",
    "Apache-2.0 (named)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (named)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 (named)": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-4.0 (named)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (named)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 (named)": "Licensed under CC BY-NC 4.0.",
    "All rights reserved": "All rights reserved.",
}
#: What makes a line a candidate, and words that tell licences apart.
CUES = ("license", "licence", "copyright", "rights reserved", "hereby granted", "redistribut", "free software", "warrant", "as is\"")
MARKS = frozenset("mit isc apache gpl gnu lesser affero mozilla cc by nc sa nd reserved".split())

_CUE = re.compile("|".join(map(re.escape, CUES)), re.IGNORECASE)
_WORD = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+")
_LINE = re.compile(r"[^\n]*\n?")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_LEVEL = 9


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float) -> None:
        self.coverage = coverage
        self.plain = zstandard.ZstdCompressor(level=_LEVEL, write_content_size=False)
        self.known = []
        for name, text in templates.items():
            words = words_of(text)
            prefix = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.known.append((name, words, zstandard.ZstdCompressor(level=_LEVEL, dict_data=prefix, write_content_size=False, write_dict_id=False)))

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """Sentences with a cue, lines with one, and runs of lines in which every third at least has one."""
        lines = [(m.start(), m.end()) for m in _LINE.finditer(text) if m.end() > m.start()]
        cued = [i for i, (a, b) in enumerate(lines) if _CUE.search(text, a, b)]
        seen = set()
        first = last = None
        for i in cued + [None]:
            if last is not None and (i is None or i - last > 3):
                if last > first:
                    seen.add((lines[first][0], lines[last][1]))
                    # What follows the last cue belongs to the notice up to the next blank line.
                    end = last
                    while end + 1 < len(lines) and end - last < 3 and text[slice(*lines[end + 1])].strip():
                        end += 1
                    seen.add((lines[first][0], lines[end][1]))
                first = i
            if i is None:
                break
            first = i if first is None else first
            last = i
            a, b = lines[i]
            seen.add((a, b))
            at = a
            for cut in [*(m.span() for m in _SENTENCE.finditer(text, a, b)), (b, b)]:
                if _CUE.search(text, at, cut[0]):
                    seen.add((at, cut[0]))
                at = cut[1]
        for a, b in sorted(seen):
            own = text[a:b]
            yield a + len(own) - len(own.lstrip()), b - (len(own) - len(own.rstrip()))

    def judge(self, block: str) -> dict | None:
        words = words_of(block)
        data = " ".join(words).encode()
        if not data:
            return None
        alone = len(self.plain.compress(data))
        ranked = sorted(((1 - len(c.compress(data)) / alone, -i) for i, (_, _, c) in enumerate(self.known)), reverse=True)
        for saved, i in ranked:
            if saved <= 0:
                break
            name, wording, _ = self.known[-i]
            pairs = aligned(wording, words)
            if not pairs:
                continue
            there, (start, end) = {p for p, _ in pairs}, (pairs[0][1], pairs[-1][1] + 1)
            missing = [w for k, w in enumerate(wording) if k not in there]
            inside = {q for _, q in pairs}
            extra = [words[k] for k in range(start, end) if k not in inside]
            told = [w for w in missing + extra if w in MARKS or w[0].isdigit()]
            if len(pairs) >= self.coverage * len(wording) and not told and len(extra) <= (1 - self.coverage) * len(wording):
                return {"license": name, "saved": saved, "matched": len(pairs), "missing": missing, "extra": extra}
        return None

    def scan(self, text: str) -> list[dict]:
        low = text.lower()
        if not any(c in low for c in CUES):
            return []
        found = []
        for a, b in self.blocks(text):
            if a < b and (hit := self.judge(text[a:b])):
                found.append(hit | {"start": a, "end": b})
        found.sort(key=lambda x: (-x["matched"], x["end"] - x["start"], x["start"]))
        kept: list[dict] = []
        for x in found:
            if all(x["end"] <= y["start"] or x["start"] >= y["end"] for y in kept):
                kept.append(x)
        return sorted(kept, key=lambda x: x["start"])


def license_blocks(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.9) -> DataFrame:
    """doc_id, start, end, license, saved (share of the compressed size), matched words, and the words
    missing and extra, a row for each confirmed block. Reads the documents once, without a shuffle."""
    templates = TEMPLATES if templates is None else templates

    def make():
        scanner = Scanner(templates, coverage)
        names = ("doc_id", "start", "end", "license", "saved", "matched", "missing", "extra")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))

        def run(batch: pa.RecordBatch) -> dict:
            rows = [x | {"doc_id": doc} for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) if text for x in scanner.scan(text)]
            return {n: pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)}

        return run

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(chosen, make, "doc_id long, start long, end long, license string, saved double, matched long, missing array<string>, extra array<string>")
