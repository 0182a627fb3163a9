import random

import numpy as np
import pytest
from pyspark.sql import types as T

from rankweave.llm import decontamination as dc

RND = random.Random(5)
SYLLABLES = "the an er on re in ti at ed or es ha st nd th of ou ble ing ion".split()


def prose(n):
    out = ""
    while len(out) < n:
        out += RND.choice(SYLLABLES) + RND.choice(["", " "])
    return out[:n]


def edited(text, edits):
    for _ in range(min(edits, len(text) - 1)):
        at = RND.randrange(len(text))
        text = RND.choice([text[:at] + text[at + 1 :], text[:at] + "x" + text[at:], text[:at] + "x" + text[at + 1 :]])
    return text


def brute(passage, text):
    """Fewest edits of the passage against any part of the text."""
    p, t = dc.folded(passage), dc.folded(text)
    row = np.zeros(len(t) + 1, int)
    for i, c in enumerate(p, 1):
        new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (t != c)]))
        ramp = np.arange(len(t) + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


@pytest.mark.parametrize("q", [6, 10])
def test_against_brute_force(q):
    passages = [prose(n) for n in (81, 120, 226, 380, 12, 9, 4, 30)]
    texts = [prose(600) for _ in range(30)]
    for k in range(60):
        part = edited(RND.choice(passages), RND.choice([0, 0, 1, 3, 6, 9, 15, 25]))
        text = prose(RND.choice([0, 0, 3, 200]))
        texts.append(text + (part.upper().replace(" ", "\n") if k % 3 else part) + prose(RND.choice([0, 2, 150])))
    index = dc.PassageIndex(list(enumerate(passages)), q)
    found = dc.matches(index, texts)
    for text, got in zip(texts, found, strict=True):
        for k, passage in enumerate(passages):
            edits = brute(passage, text)
            assert (k in got) == (edits <= index.edits[k]), (k, edits, got)
            if k in got:
                assert got[k][0] == edits
                _, start, end = got[k]
                assert brute(passage, text[start:end]) == edits


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(dc, "CHUNK", 500)
    passage = prose(150)
    index = dc.PassageIndex([(1, passage)])
    for at in (0, 430, 499, 500, 777, 2000):
        text = prose(at) + passage + prose(900)
        (_, start, end) = dc.matches(index, [text])[0][0]
        assert text[start:end] == passage


def test_tables(spark):
    passage, other = prose(100), prose(90)
    benchmark = spark.createDataFrame([(7, passage, 1), (8, None, 1), (9, "", 1), (7, passage, 1), (10, other, 1)], "item_id long, text string, doc_id int")
    docs = spark.createDataFrame([(1, "ab " + passage, 5), (2, None, 5), (3, "", 5), (None, other, 5), (4, prose(300), 5), (1, "ab " + passage, 5)], "doc_id long, text string, item_id int")
    got = sorted(map(tuple, dc.find_passages(docs, benchmark).collect()), key=str)
    assert got == sorted([(1, 7, 3, 103, 0)] * 4 + [(None, 10, 0, 90, 0)], key=str)
    kept = dc.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]


def test_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(dc, "INDEX_CHARS", 150)
    passages = [prose(100) for _ in range(5)]
    benchmark = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    docs = spark.createDataFrame([(k, prose(50) + p) for k, p in enumerate(passages)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.find_passages(docs, benchmark).collect()} == {(k, k) for k in range(5)}
    assert dc.keep_clean(docs, benchmark).count() == 0
    assert dc.find_passages(docs.limit(0), benchmark).count() == 0
    assert dc.find_passages(docs, benchmark.limit(0)).count() == 0


def test_repetitive_texts_are_scanned_in_parts(monkeypatch):
    passage = "ab" * 150
    texts = ["xyz " * 500 + "ab" * 4000 + " end of it " * 300, "ba" * 3000, "b" * 5000, "q" * 40 + passage + "q" * 40]
    index = dc.PassageIndex([(1, passage)])
    whole = dc.matches(index, texts)
    monkeypatch.setattr(dc, "HITS", 50_000)
    assert [set(m) for m in dc.matches(index, texts)] == [set(m) for m in whole] == [{0}, {0}, set(), {0}]
