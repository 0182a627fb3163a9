"""License notices in documents, by patience alignment with templates."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.common import small_batches
from rankweave.sources.tables import spread, table

#: Share of a template's words that a notice must cover.
COVERAGE = 0.8

class Template(NamedTuple):
    """A notice of a license; ``required`` are words of it without which nothing else counts, ``forbidden`` words that make it another license where they stand within the notice."""

    name: str
    text: str
    required: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()


_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by "
    "the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software"
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_THREE = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)

#: Words that name the parts of a Creative Commons license, short and long.
_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
_KINDS = ("BY", "BY-NC", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")
_VERSIONS = ("4.0", "3.0")
#: The GNU families with the word that tells them apart, and their versions.
_FAMILIES = (("GPL", "General Public License", ("3", "2")), ("LGPL", "Lesser General Public License", ("3", "2.1", "2")), ("AGPL", "Affero General Public License", ("3",)))
_KIN = ("lesser", "affero", "library")
#: Identifiers that a line of its own may name.
_IDENTIFIERS = ("MIT", "ISC", "Apache-2.0", "MPL-2.0", "EPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "CC0-1.0", "Unlicense")
_OR_ONLY = ("-only", "-or-later")


def _creative_commons() -> list[Template]:
    """Short and long notices of every kind and version; the parts of other kinds are forbidden."""
    found = []
    for kind in _KINDS:
        parts = kind.split("-")
        others = tuple(w.lower() for p, name in _PARTS.items() if p not in parts for w in (p, name))
        name = "-".join(_PARTS[p] for p in parts)
        for version in _VERSIONS:
            license_, major = f"CC-{kind}-{version}", version[0]
            found.append(Template(license_, f"Licensed under CC {kind} {version}.", ("cc", *(p.lower() for p in parts), major), others))
            long = ("commons", *(_PARTS[p].lower() for p in parts), major)
            for scope in ("International", "Unported"):
                found.append(Template(license_, f"This work is licensed under a Creative Commons {name} {version} {scope} License.", long, others))
    return found


def _gnu() -> list[Template]:
    found = []
    for family, title, versions in _FAMILIES:
        own = title.split()[0].lower()
        forbidden = tuple(w for w in _KIN if w != own)
        for version in versions:
            needed = ("gnu", own, *version.split("."))
            name = f"{family}-{version if '.' in version else version + '.0'}"
            other = forbidden if version != "2" or family != "LGPL" else (*forbidden, "1")
            found.append(Template(name, f"This work is licensed under the GNU {title}, version {version}.", needed, other))
            found.append(Template(name, _GNU.format(title, version), needed, other))
    return found


#: Common short notices, the standard headers and the whole short texts of public licenses.
TEMPLATES: tuple[Template, ...] = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2")),
    Template(
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ("apache", "2"),
    ),
    Template("MIT", "Released under the MIT License.", ("mit",)),
    Template("MIT", "MIT License", ("mit", "license")),
    Template("MIT", _MIT),
    Template("MIT", f"{_MIT}, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("fee",)),
    *_gnu(),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ("mozilla", "2")),
    Template("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", ("eclipse", "2")),
    Template("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", ("eclipse", "v1")),
    *_creative_commons(),
    Template("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.", ("dedicated", "domain")),
    Template("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("unencumbered",)),
    Template("BSD", _BSD),
    Template("BSD-2-Clause", f"{_BSD}: {_BSD_TWO}", ("redistributions",)),
    Template("BSD-3-Clause", f"{_BSD}: {_BSD_TWO} {_BSD_THREE}", ("redistributions", "endorse")),
    Template("BSD-2-Clause", "BSD 2-Clause License", ("bsd", "2", "clause")),
    Template("BSD-3-Clause", "BSD 3-Clause License", ("bsd", "3", "clause")),
    *(Template(i.removesuffix(_OR_ONLY[0]).removesuffix(_OR_ONLY[1]), f"SPDX-License-Identifier: {i}", ("identifier", *(w for w in i.lower().replace("-", " ").replace(".", " ").split() if w not in ("only", "or", "later")))) for i in _IDENTIFIERS),
)
#: Notices of so few words must stand in one piece.
SHORT = 4

_WORD = regex.compile(r"[\p{L}\p{N}]+")


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places of two sequences, rising in both.

    Equal ends are matched; between them, words that occur once in each are paired, the longest rising run of the pairs are
    anchors, and every gap between anchors is aligned in the same way. Gaps without such words stay open.
    """
    found, open_gaps = [], [(0, len(a), 0, len(b))]
    while open_gaps:
        a0, a1, b0, b1 = open_gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a[w] == 1}
        pairs = [(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if w in place]
        anchors = _rising(pairs)
        if anchors:
            found += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            open_gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(found)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rises in the second place (the first does already)."""
    tops, ends, before = [], [], []
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        before.append(ends[at - 1] if at else -1)
        tops[at : at + 1] = [y]
        ends[at : at + 1] = [k]
    run, k = [], ends[-1] if ends else -1
    while k >= 0:
        run.append(pairs[k])
        k = before[k]
    return run[::-1]


class LicenseScanner:
    """Finds the places of a text that cover a template, window by window."""

    def __init__(self, templates: Iterable[tuple] = TEMPLATES, coverage: float = COVERAGE) -> None:
        templates = [Template(*t) for t in templates]
        self.names, self.coverage = [t.name for t in templates], coverage
        split = [[w.lower() for w in _WORD.findall(t.text)] for t in templates]
        if not all(split):
            raise ValueError("a template without words")
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for ws in [*split, *(t.forbidden for t in templates)] for w in ws))}
        self.codes = [[self.vocabulary[w] for w in ws] for ws in split]
        self.required = [{self.vocabulary[w] for w in t.required} for t in templates]
        self.forbidden = [{self.vocabulary[w] for w in t.forbidden} for t in templates]
        self.weight = np.zeros((len(split), len(self.vocabulary)))
        for t, codes in enumerate(self.codes):
            np.add.at(self.weight[t], codes, 1)
        self.need = np.ceil(np.array([len(c) for c in self.codes]) * coverage - 1e-9)

    def notice(self, window: list[int], t: int) -> list[tuple[int, int]]:
        """The aligned places of a window with template ``t``; none where it covers too little, lacks a required word or holds a forbidden one."""
        own = self.codes[t]
        pairs = patience(window, own)
        if len(pairs) < self.need[t] or not self.required[t] <= {own[j] for _, j in pairs}:
            return []
        first, last = pairs[0][0], pairs[-1][0]
        if len(own) <= SHORT and last - first + 1 > len(own):
            return []
        return [] if self.forbidden[t] and self.forbidden[t] & set(window[first : last + 1]) else pairs

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, start, end) of every notice, by place in characters.

        Only windows of twice a template's length are aligned, and only where they hold enough of its words. Where notices
        overlap, the one with the most words covered counts, then the higher coverage, then the earlier place.
        """
        if not text:
            return []
        # places are those of the text: where lower case is longer (capital dotted I), words are cut before
        lower = text.lower()
        shown = lower if len(lower) == len(text) else text
        spans = [m.span() for m in _WORD.finditer(shown)] if self._may_match(shown) else []
        if not spans:
            return []
        codes = np.array([self.vocabulary.get(shown[s:e].lower(), -1) for s, e in spans])
        found = set()
        for t, own in enumerate(self.codes):
            for at in self._windows(codes, t):
                if pairs := self.notice(codes[at : at + 2 * len(own)].tolist(), t):
                    found.add((-len(pairs), -len(pairs) / len(own), at + pairs[0][0], at + pairs[-1][0], self.names[t]))
        kept: list[tuple[str, float, int, int]] = []
        taken = np.zeros(len(spans), bool)
        for _, share, first, last, name in sorted(found):
            if not taken[first : last + 1].any():
                taken[first : last + 1] = True
                kept.append((name, -share, spans[first][0], spans[last][1]))
        return sorted(kept, key=lambda r: r[2])

    def _may_match(self, text: str) -> bool:
        present = np.zeros(len(self.vocabulary))
        present[[self.vocabulary[w] for w in {w.lower() for w in set(_WORD.findall(text))} & self.vocabulary.keys()]] = 1
        return bool((self.weight @ present >= self.need).any())

    def _windows(self, codes: np.ndarray, t: int) -> list[int]:
        n = len(self.codes[t])
        member = np.concatenate([[0], np.cumsum((codes >= 0) & (self.weight[t][codes] > 0))])
        starts = np.arange(0, max(1, len(codes)), max(1, n // 2))
        held = member[np.minimum(starts + 2 * n, len(codes))] - member[starts]
        return starts[held >= self.need[t]].tolist()


def _scan(templates, coverage: float):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(templates, coverage)
        for batch in batches:
            rows = [(doc_id, *found) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for found in scanner.scan(text.as_py())]
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "license", "coverage", "start", "end"])

    return scan


def scan_licenses(docs: DataFrame, templates: Iterable[tuple] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, start, end of every license notice that a document holds.

    Words are runs of letters and digits in lower case; a notice covers at least ``coverage`` of a template's words in
    order, its required words among them, and holds no forbidden one. Of notices that overlap, that with the most words covered counts, then the higher
    coverage, then the earlier place. ``templates`` are (name, text), (name, text, required words) or (name, text, required words, forbidden words). Whole texts are
    scanned; null or empty ones hold nothing; equal rows each have their results; other columns are ignored; an empty table
    gives no rows.
    """
    docs = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return docs.mapInArrow(_scan(tuple(templates), coverage), "doc_id long, license string, coverage double, start long, end long")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
