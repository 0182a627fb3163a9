import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from rankweave.llm import license_scan as ls


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@given(st.lists(st.integers(0, 12), max_size=30), st.lists(st.integers(0, 12), max_size=30))
@settings(max_examples=300, deadline=None)
def test_alignment_is_common_and_rising(a, b):
    pairs = ls.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))
    assert len(pairs) <= longest_common(a, b)


@given(st.permutations(range(12)), st.permutations(range(12)))
@settings(max_examples=100, deadline=None)
def test_words_that_are_all_unique_are_aligned_best(a, b):
    assert len(ls.patience(a, b)) == longest_common(a, b)


def test_notices_with_changes():
    scanner, rnd = ls.LicenseScanner(), random.Random(4)
    filler = lambda n: " ".join(rnd.choice(["the", "onre", "under", "thand", "license", "of", "and"]) for _ in range(n))
    for name, text, required, _ in ls.TEMPLATES:
        words = text.split()
        for drop in (0, len(words) // 12):
            kept = words[:]
            for _ in range(drop):
                at = rnd.randrange(1, len(kept) - 1)
                if not any(w in kept[at].lower() for w in required):
                    kept.pop(at)
            whole = f"{filler(300)}\n{' '.join(kept).upper()}\n{filler(40)}"
            found = [r for r in scanner.scan(whole) if r[0] == name]
            assert len(found) == 1, (name, drop)
            if not drop and len(words) > ls.SHORT:  # around a short one the filler may complete a longer notice
                assert found[0][1] == 1 and whole[found[0][2] : found[0][3]] in text.upper()


def test_repeated_notices_and_texts_without():
    scanner = ls.LicenseScanner()
    notice = "Released under the MIT License. "
    assert {x[0] for x in scanner.scan(notice * 50)} == {"MIT"}
    assert scanner.scan("the license of the work is under the software and version of the public " * 40) == []
    assert scanner.scan("Licensed under the Other License, Version 9.") == []


def names(text):
    return [r[0] for r in ls.LicenseScanner().scan(text)]


def test_required_words_and_variants():
    assert names("This work is released. Licensed under the Apache License, Version 2.0.") == ["Apache-2.0"]
    assert names("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.") == ["CC-BY-SA-4.0"]
    assert names(ls._GNU.format("Lesser General Public License", 3)) == ["LGPL-3.0"] and names(ls._GNU.format("General Public License", 2)) == ["GPL-2.0"]
    assert names(f"{ls._BSD}: 1. {ls._BSD_TWO} 3. {ls._BSD_THREE}") == ["BSD-3-Clause"] and names(f"{ls._BSD}: {ls._BSD_TWO}") == ["BSD-2-Clause"] and names(ls._BSD) == ["BSD"]
    between = " words of the text that part both notices from each other, enough of them to be sure. " * 3
    assert names(f"Released under the MIT License.{between}Licensed under CC BY-NC 4.0.{between}Released under the MIT License.") == ["MIT", "CC-BY-NC-4.0", "MIT"]


def plain_scan(scanner, text):
    """Names by aligning a window at every word of the text."""
    codes = [scanner.vocabulary.get(w.lower(), -1) for w in ls._WORD.findall(text)]
    return {scanner.names[t] for t, own in enumerate(scanner.codes) for at in range(len(codes)) if scanner.notice(codes[at : at + 2 * len(own)], t)}


def test_against_windows_at_every_word():
    templates = [t for t in ls.TEMPLATES if len(t.text) < 90 and t.name in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "LGPL-3.0")]
    scanner, rnd = ls.LicenseScanner(templates), random.Random(8)
    for _ in range(60):
        words = [rnd.choice(["the", "work", "under", "license", "x", "version", "y", "z", "public"]) for _ in range(60)]
        for t in rnd.sample(templates, rnd.choice([0, 1, 1, 2])):
            own = t.text.split()
            if rnd.random() < 0.5:
                own.pop(rnd.randrange(len(own)))
            at = rnd.randrange(60)
            words[at:at] = own
        text = " ".join(words)
        found = {r[0] for r in scanner.scan(text)}
        assert found <= plain_scan(scanner, text)
        for t in templates:
            if t.text in text:
                assert found, text


def test_table(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, f"x y. {gpl}"), (2, None), (3, ""), (None, gpl), (1, f"x y. {gpl}"), (4, "w " * 300_000 + gpl), (5, "nothing")]
    got = ls.scan_licenses(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, license int")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "4", "None"]
    assert {(r.license, r.coverage) for r in got} == {("GPL-3.0", 1.0)}
    assert ls.scan_licenses(spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string"))).count() == 0


def test_query_finds_the_planted_lines(spark):
    sf = "/root/testdata/sf0.01"
    lines = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    expected = {(r.doc_id, n) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for n, line in lines.items() if re.search(re.escape(line), r.text or "")}
    assert {(r.doc_id, r.license) for r in ls.op2_license_scan(spark, sf).collect()} == expected


def test_a_capital_dotted_i_changes_nothing_else():
    notice = "Released under the MIT License."
    for text in (f"\u0130stanbul. {notice}", f"{notice} \u0130stanbul"):
        at = text.index(notice)
        assert ls.LicenseScanner().scan(text) == [("MIT", 1.0, at, at + len(notice) - 1)]
    assert ls.LicenseScanner([("city", "\u0130stanbul Belediyesi")]).scan("\u0130STANBUL BELEDIYESI") == [("city", 1.0, 0, 19)]


@pytest.mark.parametrize(
    ("notice", "name"),
    [
        ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("CC BY-NC-SA 4.0", None),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
        ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
        ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "CC-BY-3.0"),
        ("Licensed under the Apache License, Version 1.0", None),
        ("Licensed under the Apache License, Version 2.0", "Apache-2.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 2.", "LGPL-2.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
        ("This work is licensed under the GNU Library General Public License, version 2.", None),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("SPDX-License-Identifier: MIT", "MIT"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
        ("MIT License\n\nCopyright", "MIT"),
        ("mit der License", None),
        ("BSD 3-Clause License", "BSD-3-Clause"),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "EPL-2.0"),
        ("All rights reserved.", None),
    ],
)
def test_words_that_tell_licenses_apart(notice, name):
    assert {r[0] for r in ls.LicenseScanner().scan(f"Some words before. {notice} Some words after.")} == ({name} if name else set())
