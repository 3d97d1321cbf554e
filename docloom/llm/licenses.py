"""License scans by conditional compression.

Method: candidate blocks are cut around words that license notices use. In a
block, windows as wide as a template may be are passed over if they hold too
few of its words to be confirmed, in whatever order. The others are compressed,
as words, alone and with the template as a raw zstandard dictionary; where that
saves bytes the template is confirmed by the exact differences in wording: its
words are aligned with the window's, and words missing from and words put
between the aligned ones are counted. What surrounds a window has no say.

A block reaches as far around cue words as any template's wording lies from
them, and a template without one has its longest word as a cue, so templates of
any length, whole license texts among them, lie in one block.

Cases: null and empty texts have no blocks; texts of any length are read whole
(blocks that touch are one, cut every LONGEST characters or thrice the longest
template, with an overlap as long as that); windows that
overlap are aligned together, and again on both sides of what is found, and one
by one if nothing is; of findings that overlap the one with more words in
agreement stays, of ties the first, then the first name; repeated rows get
repeated results; an empty table gives an empty result; other columns pass
through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of, unused

#: Wording of public license notices (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
CUE = re.compile(r"licen[sc]e|permission|redistribut|copyright|warrant|\bCC BY|public license|SPDX", re.I)
WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
AROUND, LONGEST = 160, 4000
LEVEL = 3
#: A template is confirmed if this share of its words is there, and at most that many others a template word lie between.
SHARE, BETWEEN = 0.9, 0.1


class Templates:
    def __init__(self, texts: tuple[tuple[str, str], ...]) -> None:
        self.words = {k: [w.lower() for w in WORD.findall(t)] for k, t in sorted(texts)}
        self.counts = {k: Counter(w) for k, w in self.words.items()}
        self.least = {k: math.ceil(SHARE * len(w) - 1e-9) for k, w in self.words.items()}
        self.width = {k: len(w) + int(BETWEEN * len(w) + 1e-9) for k, w in self.words.items()}
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.packers = {}
        for k, w in self.words.items():
            raw = zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.packers[k] = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.cue = re.compile("|".join([CUE.pattern, *sorted({re.escape(max(WORD.findall(t), key=len)) for _, t in texts if not CUE.search(t) and WORD.search(t)})]), re.I)
        # words between a template's own ones make its wording longer
        stretch = lambda n: math.ceil(n * (1 + 2 * BETWEEN)) + 40
        self.overlap = max((stretch(len(t)) for _, t in texts), default=0)
        self.around = max([AROUND, *(stretch(self.farthest(t)) for _, t in texts)])
        self.longest = max(LONGEST, 3 * (self.overlap + 2 * self.around))

    def farthest(self, text: str) -> int:
        """The most characters of a text without a cue."""
        places = [0, *(x for m in self.cue.finditer(text) for x in m.span()), len(text)]
        return max(b - a for a, b in zip(places[::2], places[1::2], strict=True))

    def blocks(self, text: str) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for m in self.cue.finditer(text):
            a, b = max(0, m.start() - self.around), min(len(text), m.end() + self.around)
            if out and a <= out[-1][1]:
                a = out.pop()[0]
            out.append((a, b))
        cut = []
        for a, b in out:
            k = a
            while True:
                cut.append((k, min(b, k + self.longest)))
                if k + self.longest >= b:
                    break
                k += self.longest - self.overlap - 2 * self.around
        return cut

    def saved(self, name: str, have: list[str]) -> int:
        """Bytes that the template saves as a dictionary of these words."""
        raw = " ".join(have).encode("utf-8", "surrogatepass")
        return len(self.alone.compress(raw)) - len(self.packers[name].compress(raw))

    def windows(self, name: str, have: list[str], low: int, high: int) -> list[tuple[int, int]]:
        """Where have[low:high] holds enough of the template's words within its width; windows that follow one another are joined."""
        counts, least, width, out = self.counts[name], self.least[name], self.width[name], []
        if not least or high - low < least:
            return out
        inside, same = dict.fromkeys(counts, 0), 0
        for k in range(low, high):
            w = have[k]
            if w in counts:
                same += inside[w] < counts[w]
                inside[w] += 1
            if k - width >= low and (w := have[k - width]) in counts:
                inside[w] -= 1
                same -= inside[w] < counts[w]
            if same >= least:
                a = max(low, k - width + 1)
                if out and a <= out[-1][0] + out[-1][2]:
                    out[-1][1], out[-1][2] = k + 1, a - out[-1][0] + 1
                else:
                    out.append([a, k + 1, 1])
        return [(a, b) for a, b, _ in out]

    def aligned(self, name: str, have: list[str], low: int, high: int) -> tuple[int, int, int, int] | None:
        """(first word, end, missing, between) of the template's wording around the longest part of it in have[low:high]."""
        want = self.words[name]
        parts = [p for p in SequenceMatcher(None, have[low:high], want, autojunk=False).get_matching_blocks() if p.size]
        if not parts:
            return None
        # the alignment is cut to where its words lie close together, around its longest part
        core = max(range(len(parts)), key=lambda k: parts[k].size)
        first = last = core
        room = max(2, round(BETWEEN * len(want)))
        while first > 0 and parts[first].a - (parts[first - 1].a + parts[first - 1].size) <= room:
            first -= 1
        while last + 1 < len(parts) and parts[last + 1].a - (parts[last].a + parts[last].size) <= room:
            last += 1
        same = sum(p.size for p in parts[first : last + 1])
        a, b = low + parts[first].a, low + parts[last].a + parts[last].size
        if same < self.least[name] or b - a - same > self.width[name] - len(want):
            return None
        return a, b, len(want) - same, b - a - same

    def confirm(self, name: str, have: list[str]) -> list[tuple[int, int, int, int]]:
        """Occurrences (first word, end, missing, between) of a template's wording; some may overlap."""
        distinct = self.counts[name].keys()
        if len(distinct & set(have)) < len(distinct) - len(self.words[name]) + self.least[name]:
            return []
        out, todo, width = [], [(0, len(have))], self.width[name]
        while todo:
            for low, high in self.windows(name, have, *todo.pop()):
                if self.saved(name, have[low:high]) <= 0:
                    continue
                if hit := self.aligned(name, have, low, high):
                    out.append(hit)
                    todo += [(low, hit[0]), (hit[1], high)]
                elif high - low > width:
                    out += [h for k in range(low, high - width + 1) if (h := self.aligned(name, have, k, k + width))]
        return out

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, int, int, int]]]:
        """(blocks, findings): (license, start, end, missing words, words between), in code points."""
        blocks, found = self.blocks(text or ""), {}
        for a, b in blocks:
            places = list(WORD.finditer((text or "")[a:b]))
            have = [m[0].lower() for m in places]
            for name in self.words:
                for first, end, missing, between in self.confirm(name, have):
                    key = (a + places[first].start(), a + places[end - 1].end())
                    old = found.get(key)
                    if old is None or (missing + between, name) < (old[3] + old[4], old[0]):
                        found[key] = (name, *key, missing, between)
        rows, kept = sorted(found.values(), key=lambda r: (2 * r[3] + r[4] - len(self.words[r[0]]), r[1], r[0])), []
        for r in rows:  # of overlapping findings the one with more words in agreement, less the differences, stays
            if all(r[2] <= k[1] or k[2] <= r[1] for k in kept):
                kept.append(r)
        return len(blocks), sorted(kept, key=lambda r: (r[1], r[0]))


@lru_cache(maxsize=4)
def templates(texts: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(texts)


FOUND = "array<struct<license:string,start:int,end:int,missing:int,between:int>>"


def scan_licenses(docs: DataFrame, text: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """docs with n_blocks and found: array of license, start, end, missing, between."""
    ship(docs.sparkSession)
    listed = tuple(sorted((texts or TEMPLATES).items()))

    @F.pandas_udf(f"n_blocks long, found {FOUND}")
    def scan(column: pd.Series) -> pd.DataFrame:
        t = templates(listed)
        names = ("license", "start", "end", "missing", "between")
        rows = [(n, [dict(zip(names, f, strict=True)) for f in found]) for n, found in map(t.scan, column)]
        return pd.DataFrame(rows, columns=["n_blocks", "found"])

    keep = [c for c in docs.columns if c not in ("n_blocks", "found")]
    own = unused(docs, "scan")
    return docs.withColumn(own, scan(text_of(text))).select(*keep, f"{own}.n_blocks", f"{own}.found")
