"""License scans by conditional compression.

Words from which all known wordings can be told are cues.  Around a cue, windows are compressed alone and
with each license's wordings as a raw zstandard dictionary: for short statements every window of a statement's
size that has the cue in its place, for notices as many words as a notice may reach.  All licenses with enough
reduction, or for notices with enough bytes saved beside their smallest one, are confirmed by the exact
differences in wording: no number may differ, a short statement must be whole, and a notice may differ in a
tenth of its words.  Prose before or behind a statement does not count against it, and every confirmed license
is reported, but for a wording that lies within a longer one.

Cues follow from the wordings: one word of a short statement, all of which must be there, and of a notice one
word more than may be missing.  All words of a text are looked at, over line ends.

Defined results: null and empty texts hold no license; equal lines are equal findings, one row each;
repeated rows are scanned one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# Names by which licenses are called, by SPDX identifier.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "MIT": ["the MIT License", "the MIT license", "MIT"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "BSD-3-Clause"],
    "ISC": ["the ISC License", "ISC"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU GPL v2", "GPL-2.0"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU GPL v3", "GPL-3.0"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPL-3.0"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "MPL-2.0"],
    "Unlicense": ["the Unlicense", "Unlicense"],
    **{f"CC-{kind}-{v}": [f"CC {kind} {v}"]
       for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")},
    "CC0-1.0": ["CC0 1.0", "CC0-1.0"],
}
# Phrases around a name.
PHRASES = ["Licensed under {}", "Released under {}", "This work is licensed under {}", "Distributed under {}",
           "SPDX-License-Identifier: {}", "Available under the terms of {}"]
_BSD = ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."]
_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
             "that the following conditions are met:")
# Beginnings of the public notices.
NOTICES = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"],
    "BSD-2-Clause": [_BSD_HEAD],
    "BSD-3-Clause": [" ".join([_BSD_HEAD, *_BSD]), " ".join([_BSD_HEAD, *(f"{k}. {c}" for k, c in enumerate(_BSD, 1))])],
    "LicenseRef-All-Rights-Reserved": ["All rights reserved."],
    **{f"GPL-{v}.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                      f"Public License as published by the Free Software Foundation, either version {v} of the License"]
       for v in (2, 3)},
}
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
LEAST_REDUCTION = 0.2
SHORT = 14
_KEEP = 1 << 14


@dataclass(frozen=True)
class Finding:
    license_id: str
    reduction: float
    n_missing: int
    n_added: int
    first: int  # words of the window that the wording spans
    last: int


def default_wordings() -> dict[str, list[str]]:
    out = {k: [p.format(name) for name in names for p in PHRASES] for k, names in NAMES.items()}
    for k, notices in NOTICES.items():
        out[k] = out.get(k, []) + notices
    return out


def allowed(wording: list[str]) -> int:
    """Words of a wording that may be missing or added."""
    return 0 if len(wording) <= SHORT else len(wording) // 10


def cues(wording: list[str]) -> list[str]:
    """Words of which the wording holds one whenever it is confirmed: of its longest, one more than may be missing."""
    return sorted(dict.fromkeys(wording), key=lambda w: (-len(w), w))[:allowed(wording) + 1]


class Scanner:
    """Ranks licenses for the words around a cue by conditional compression and confirms them by wording."""

    def __init__(self, wordings: dict[str, list[str]] | None = None):
        self.wordings = wordings or default_wordings()
        self.words = {k: sorted((x for w in v if (x := _WORD.findall(w.lower()))), key=len, reverse=True) for k, v in self.wordings.items()}
        every = [w for v in self.words.values() for w in v]
        # Of short statements: the places (before the cue, from the cue on) that a window around a cue may take.
        self.places: dict[str, list[tuple[int, int]]] = {}
        for w in every:
            if len(w) <= SHORT:
                at = w.index(cues(w)[0])
                self.places[w[at]] = sorted({*self.places.get(w[at], []), (at, len(w) - at)})
        notices = [w for w in every if len(w) > SHORT]
        self.reach = max((len(w) + allowed(w) for w in notices), default=0)
        self.notice_cues = frozenset(c for w in notices for c in cues(w))
        some = "|".join(sorted(map(re.escape, self.notice_cues | set(self.places))))
        self.cue = re.compile(rf"(?<![a-z0-9])(?:{some})(?![a-z0-9])") if some else re.compile(r"(?!)")
        self.plain = zstandard.ZstdCompressor(level=9, write_content_size=False)
        self.given = {
            k: zstandard.ZstdCompressor(level=9, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
                "\n".join(v).lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, v in self.wordings.items()}
        self.least = {k: LEAST_REDUCTION * min(len(self.plain.compress(" ".join(w).encode())) for w in v if len(w) > SHORT)
                      for k, v in self.words.items() if any(len(w) > SHORT for w in v)}
        self.known: dict[tuple[str, bool], list[Finding]] = {}

    def ranked(self, block: str) -> list[tuple[int, float, str]]:
        """(bytes saved, relative reduction, license), the largest first."""
        data = block.lower().encode()
        alone = len(self.plain.compress(data))
        sizes = {k: len(c.compress(data)) for k, c in self.given.items()}
        return sorted(((alone - n, 1 - n / alone, k) for k, n in sizes.items()), key=lambda x: (-x[0], x[2]))

    def statements(self, block: list[str]) -> list[Finding]:
        """The licenses that the block as a whole states."""
        return [Finding(k, reduction, 0, 0, 0, len(block)) for _, reduction, k in self.ranked(" ".join(block))
                if reduction >= LEAST_REDUCTION and block in self.words[k]]

    def notices(self, block: list[str]) -> list[Finding]:
        """The notices within the block, each as often as it is there."""
        out = []
        for saved, _, k in self.ranked(" ".join(block)):
            if saved < self.least.get(k, saved + 1):
                continue
            for wording in self.words[k]:
                if len(wording) > SHORT:
                    out += self.notice(block, 0, len(block), wording, k)
        return out

    def notice(self, block: list[str], low: int, high: int, wording: list[str], license_id: str) -> list[Finding]:
        """A wording in these words of the block, where they fit it best, and in those before and after."""
        if high - low < len(wording) - allowed(wording):
            return []
        runs = [r for r in SequenceMatcher(None, block[low:high], wording, autojunk=False).get_matching_blocks() if r.size]
        # Words of the prose around that occur in the wording too are no part of it.
        while len(runs) > 1 and runs[1].a - runs[0].a - runs[0].size > runs[0].size:
            runs.pop(0)
        while len(runs) > 1 and runs[-1].a - runs[-2].a - runs[-2].size > runs[-1].size:
            runs.pop()
        if not runs:
            return []
        first, last = low + runs[0].a, low + runs[-1].a + runs[-1].size
        hit = {k for r in runs for k in range(r.b, r.b + r.size)}
        used = {low + k for r in runs for k in range(r.a, r.a + r.size)}
        missing = [w for k, w in enumerate(wording) if k not in hit]
        added = [block[k] for k in range(first, last) if k not in used]
        out = self.notice(block, low, first, wording, license_id) + self.notice(block, last, high, wording, license_id)
        if len(missing) + len(added) <= allowed(wording) and not any(c.isdigit() for w in missing + added for c in w):
            reduction = next(r for _, r, k in self.ranked(" ".join(block[first:last])) if k == license_id)
            out.append(Finding(license_id, reduction, len(missing), len(added), first, last))
        return out

    def window(self, words: list[str], notice: bool) -> list[Finding]:
        """What a window holds; remembered, as the same come again and again."""
        known = (" ".join(words), notice)
        if known not in self.known:
            if len(self.known) >= _KEEP:
                self.known.clear()
            self.known[known] = self.notices(words) if notice else self.statements(words)
        return self.known[known]

    def text(self, text: str | None) -> list[dict]:
        """Findings of a text by the line on which they begin."""
        if not text or not self.cue.search(text.lower()):
            return []
        lines = text.split("\n")
        words, line_of = [], []
        for k, line in enumerate(lines):
            here = _WORD.findall(line.lower())
            words += here
            line_of += [k] * len(here)
        spans: dict[tuple[int, int, str], Finding] = {}
        done = 0  # the notices with a cue before this word are in an earlier window
        for k, word in enumerate(words):
            windows = [(k - before, k + after, False) for before, after in self.places.get(word, ()) if before <= k and k + after <= len(words)]
            if word in self.notice_cues and k >= done:
                done = k + self.reach
                windows.append((max(0, k - self.reach), min(len(words), k + 2 * self.reach), True))
            for low, high, notice in windows:
                for f in self.window(words[low:high], notice):
                    spans[low + f.first, low + f.last, f.license_id] = f
        out, end, widest = [], -1, None
        # By beginning, the longest first: what ends no later than an earlier one lies within it.
        for (first, last, license_id), f in sorted(spans.items(), key=lambda x: (x[0][0], -x[0][1], x[0][2])):
            if last > end:
                end, widest = last, (first, last)
            elif (first, last) != widest:
                continue
            low, high = line_of[first], line_of[last - 1]
            out.append({"line": low, "license_id": license_id, "n_missing": f.n_missing, "n_added": f.n_added,
                        "reduction": f.reduction, "block": "\n".join(lines[low:high + 1])})
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", wordings: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows (doc_id, line, license_id, n_missing, n_added, reduction, block), one per license that is stated."""
    names = ["line", "license_id", "n_missing", "n_added", "reduction", "block"]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wordings)
        for batch in batches:
            ids, found = [], []
            for doc_id, t in zip(*(c.to_pylist() for c in batch.columns)):
                here = scanner.text(t)
                ids += [doc_id] * len(here)
                found += here
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), *(pa.array([f[n] for f in found], kind) for n, kind in zip(names, kinds))],
                names=["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, line int, license_id string, "
                                "n_missing int, n_added int, reduction double, block string")
