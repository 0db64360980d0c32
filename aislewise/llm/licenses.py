"""License notices by conditional compression.

Lines with the vocabulary of license notices form candidate blocks. Windows of a block, a little longer than a
wording, are compressed alone and with the wording as raw zstandard dictionary; the share of bytes that the
wording saves ranks them, for its words save little in any other text. The winners are aligned with the
wording word by word: what differs is returned, and the gain of the notice itself decides whether a changed one
counts. A notice may name its holder and year freely; those words of a template are left open.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import map_arrow, texts_of

CUES = r"(?i)licen[cs]|copyright|\(c\)|all rights reserved|permission|warrant|redistribut|spdx|public domain|creative commons|\bcc[ -](?:by|0)"
# A window is looked at if a wording saves this much of it, a changed notice counts if it saves this much of the notice.
RANK_GAIN, MIN_GAIN = 0.1, 0.25
MIN_SHARE = 0.85
WINDOW = 400
GAP = 3
LEVEL = 9

# Wordings of public licenses (fixed values); "<>" is a word that may be anything.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        'the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "All rights reserved": ("All rights reserved.", "Copyright (c) <> <>. All rights reserved."),
}


class Finding(NamedTuple):
    """A confirmed notice: its license, the words of the block it spans, and how its wording differs."""

    license: str
    first: int
    last: int
    gain: float
    missing: list[str]
    added: list[str]


WORD = re.compile(r"<>|[\w.+-]*\w")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Wording(NamedTuple):
    license: str
    words: list[str]
    compressor: zstandard.ZstdCompressor

    @property
    def slack(self) -> int:
        return len(self.words) // 2 + 6


class Templates:
    """Compressors for every wording, made once in a task."""

    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.wordings = []
        for name, wordings in templates.items():
            for wording in wordings:
                raw = zstandard.ZstdCompressionDict(wording.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                made = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False)
                self.wordings.append(Wording(name, words(wording), made))

    def gain(self, wording: Wording, text: str) -> float:
        """Share of the compressed size that the wording as dictionary saves, whatever the case of letters."""
        data = text.lower().encode()
        return 1 - len(wording.compressor.compress(data)) / len(self.alone.compress(data))

    def candidates(self, block: str, spans: list[tuple[int, int]]) -> list[tuple[float, Wording, int, int]]:
        """Windows of the block's words in which a wording saves at least ``RANK_GAIN``, by falling gain.

        A window is half as long again as the wording and moves by half of it, so each notice lies whole in one.
        """
        out = []
        for wording in self.wordings:
            size, step = len(wording.words) + wording.slack, max(1, wording.slack)
            for low in range(0, max(1, len(spans) - size + step), step):
                high = min(low + size, len(spans))
                gain = self.gain(wording, block[spans[low][0] : spans[high - 1][1]])
                if gain >= RANK_GAIN:
                    out.append((gain, wording, low, high))
        return sorted(out, key=lambda c: -c[0])

    def findings(self, block: str) -> list[Finding]:
        """Notices of a block: winners of the compression whose wording is confirmed, in order of place.

        The best ranked windows are aligned first. A place whose every word the wording has is exact. One that
        misses or adds words counts if its own gain is at least ``MIN_GAIN`` and it shares no matched word with
        a better place; an exact one counts unless it lies within an exact place of the same license.
        """
        spans = [m.span() for m in WORD.finditer(block)]
        said = [block[a:b].lower() for a, b in spans]
        places: dict[tuple, tuple[Finding, set[int]]] = {}
        for _, wording, low, high in self.candidates(block, spans) if spans else ():
            for missing, added, matched in confirmed(wording.words, said[low:high]):
                first, last = low + min(matched), low + max(matched)
                gain = self.gain(wording, block[spans[first][0] : spans[last][1]])
                if gain >= MIN_GAIN or not (missing or added):
                    places[wording.license, first, last, len(matched)] = (Finding(wording.license, first, last, gain, missing, added), {low + k for k in matched})
        stay: list[tuple[Finding, set[int]]] = []
        for f, matched in sorted(places.values(), key=lambda p: (len(p[0].missing) + len(p[0].added), -len(p[1]), -p[0].gain, p[0].first, p[0].license)):
            exact = not (f.missing or f.added)
            if all(matched.isdisjoint(other) or exact and not (g.license == f.license and matched <= other) for g, other in stay):
                stay.append((f, matched))
        return sorted((f for f, _ in stay), key=lambda f: (f.first, f.license))


def confirmed(wording: list[str], said: list[str]) -> Iterator[tuple[list[str], list[str], set[int]]]:
    """Missing words, added words and matched places of the wording in a window: where it stands word by word, else at its best alignment."""
    whole = False
    for at in range(len(said) - len(wording) + 1):
        if all(a == b or a == "<>" for a, b in zip(wording, said[at:])):
            whole = True
            yield [], [], {at + k for k, w in enumerate(wording) if w != "<>"}
    missing, added, share = differences(wording, said)
    if not whole and share >= MIN_SHARE:
        match = difflib.SequenceMatcher(None, wording, said, autojunk=False).get_matching_blocks()
        yield missing, added, {b + k for _, b, size in match for k in range(size)}


def differences(wording: list[str], said: list[str]) -> tuple[list[str], list[str], float]:
    """Words of the template that the block lacks, words the block has amid it, share of the template found."""
    match = difflib.SequenceMatcher(None, wording, said, autojunk=False)
    spans = [b for b in match.get_matching_blocks() if b.size]
    missing: list[str] = []
    added: list[str] = []
    if not spans:
        return wording, [], 0.0
    at, place = 0, spans[0].b
    for a, b, size in spans:
        lost, extra = wording[at:a], said[place:b]
        free = lost.count("<>")
        missing += [w for w in lost if w != "<>"]
        added += extra[free:] if free else extra
        at, place = a + size, b + size
    missing += [w for w in wording[at:] if w != "<>"]
    fixed = sum(w != "<>" for w in wording)
    return missing, added, (fixed - len(missing)) / fixed


def blocks(text: str, cue: re.Pattern) -> list[tuple[int, int]]:
    """Character ranges of candidate blocks: lines with a cue, and lines between two of them that are at most three apart."""
    out: list[tuple[int, int]] = []
    at, last = 0, -GAP - 2
    for number, line in enumerate(text.split("\n")):
        if cue.search(line):
            if out and number - last <= GAP + 1:
                out[-1] = (out[-1][0], at + len(line))
            else:
                out.append((at, at + len(line)))
            last = number
        at += len(line) + 1
    return out


def windows(text: str, start: int, end: int, size: int) -> list[tuple[int, int]]:
    """A block in windows of at most ``size`` words that overlap by half, so that what is half as long lies whole in one."""
    places = [m.span() for m in WORD.finditer(text, start, end)]
    if len(places) <= size:
        return [(start, end)]
    step = size // 2
    return [(places[k][0], places[min(k + size, len(places)) - 1][1]) for k in range(0, len(places) - step, step)]


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """``(doc_id, start, end, license, gain, exact, missing, added)``: one row per license notice found.

    ``start`` and ``end`` are characters of the notice; a block of text in which no license is confirmed gives one
    row with a null license and the block's characters. A text that is null, empty or without a cue gives no row.
    Equal rows give equal findings. A wording may be of any length; ``templates`` replaces the list.
    """
    longest = max(len(words(w)) for wordings in templates.values() for w in wordings)
    size = max(WINDOW, 4 * longest)

    def notices(text: str, start: int, end: int) -> list[tuple]:
        found: dict[tuple, tuple] = {}
        for a, b in windows(text, start, end, size):
            block = text[a:b]
            if block not in known:
                if len(known) >= 20_000:
                    known.clear()
                spans = [m.span() for m in WORD.finditer(block)]
                known[block] = [(spans[f.first][0], spans[f.last][1], f) for f in made[0].findings(block)]
            for low, high, f in known[block]:
                exact = not (f.missing or f.added)
                found.setdefault((a + low, f.license), (a + low, a + high, f.license, f.gain, exact, f.missing, f.added))
        return sorted(found.values(), key=lambda r: r[:3])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Templates(templates))
        cue = re.compile(CUES)
        rows = []
        for doc_id, data in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            text = data.decode()
            for start, end in blocks(text, cue):
                for notice in notices(text, start, end) or [(start, end, None, 0.0, False, [], [])]:
                    rows.append((doc_id, *notice))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(TYPES)], NAMES)

    made: list[Templates] = []
    known: dict[str, list[tuple[int, int, Finding]]] = {}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows.where(F.col("text").rlike(CUES)), run, SCHEMA, "text")


SCHEMA = "doc_id long, start long, end long, license string, gain double, exact boolean, missing array<string>, added array<string>"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string())]
