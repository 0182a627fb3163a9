import random
import re

import numpy as np
from pyspark.sql import types as T

from rankweave.llm import line_dedup as ld


def words(line):
    return {w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w}


def brute(rows):
    lines = sorted({((d is None, d or 0, k), frozenset(words(line))) for d, t in rows if t is not None for k, line in enumerate(t.split("\n"))}, key=lambda r: r[0])
    lines = [(place, own) for place, own in lines if own]
    return {(None if place[0] else place[1], place[2]) for k, (place, own) in enumerate(lines) if any(100 * len(o & own) >= 75 * len(o | own) for _, o in lines[:k])}


def corpus(n=60, seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    pool = [rnd.sample(vocab, rnd.choice([1, 2, 3, 4, 8, 20, 60])) for _ in range(12)]
    rows = []
    for k in range(n):
        lines = []
        for _ in range(rnd.randrange(1, 7)):
            own = rnd.choice(pool)[:] if rnd.random() < 0.7 else rnd.sample(vocab, rnd.choice([3, 6, 15]))
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                own[rnd.randrange(len(own))] = rnd.choice(vocab)
            if rnd.random() < 0.3:
                rnd.shuffle(own)
            lines.append(" ".join(own))
        rows.append((k, "\n".join(lines)))
    return rows


EDGES = [(500, None), (501, ""), (502, "\n\n \t\n"), (503, "A b C\na B c\nx y"), (504, "a b c d e f g h\nx y z\r\n a\t b  C"), (505, "h a q c d e f g\nZ y x\ny X"), (None, "z x y\na b c d e f g h i\nnull id line here\na b c")]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed=seed) + EDGES
        docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, line_no int").repartition(3)
        got = ld.later_matches(docs).collect()
        assert {(r.doc_id, r.line_no) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_early_lines_are_similar_and_earlier(spark):
    rows = corpus(40, 5)
    lines = {(d, k): words(line) for d, t in rows for k, line in enumerate(t.split("\n"))}
    for r in ld.later_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        late, early = lines[r.doc_id, r.line_no], lines[r.early_doc_id, r.early_line_no]
        assert (r.early_doc_id, r.early_line_no) < (r.doc_id, r.line_no) and 100 * len(late & early) >= 75 * len(late | early)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(ld, "SENT", 0)
    rows = corpus(seed=3)
    got = ld.later_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line_no) for r in got} == brute(rows)


def test_many_near_copies(spark):
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(30)]
    rows = []
    for k in range(150):
        own = base[:]
        own[rnd.randrange(30)] = f"own{k}"
        rows.append((k, " ".join(own)))
    got = ld.later_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line_no) for r in got} == brute(rows) == {(k, 0) for k in range(1, 150)}


def test_texts_keep_their_other_lines(spark):
    rows = [(1, "one two three four\nother line of words\n\nx"), (2, "zzz\nOne two  three four \nlast"), (3, "one two three four"), (3, "one two three four"), (4, None)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, gone int")
    out = ld.dedup_lines(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(1, rows[0][1]), (2, "zzz\nlast"), (3, ""), (3, ""), (4, None)]))


def test_rows_that_share_an_id_lose_their_own_lines_alone(spark):
    rows = [(1, "alpha beta gamma"), (5, "alpha beta gamma"), (5, "something else entirely"), (None, "alpha beta gamma"), (None, "a text of its own"), (None, None)]
    out = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [rows[0], (5, ""), rows[2], (None, ""), rows[4], rows[5]]))


def test_empty_table(spark):
    docs = spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string"))
    assert ld.later_matches(docs).count() == 0 and ld.dedup_lines(docs).count() == 0


def test_the_query_compares_single_words(spark, tmp_path):
    line = "one two three four five six seven eight"
    spark.createDataFrame([(1, line), (2, line.replace("four", "4"))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in ld.op10_line_dedup(spark, str(tmp_path)).collect()] == [(2, 0, 1, 0)]


def test_short_lines_meet_their_copies(spark):
    rows = [(1, "Menu\nread more\n\n  \n今天天气很好"), (2, " menu \nread less\n\n  \n今天天气很好"), (3, "more read")]
    got = ld.later_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(2, 0, 1, 0), (2, 4, 1, 4), (3, 0, 1, 1)]


def test_words_and_tokens_of_blocks(monkeypatch):
    monkeypatch.setattr(ld, "PIECE", 16)
    text = "a bb a  ccc\n\n  zz ünï a\n" + "x" * 50 + " a bb\nccc a bb\n"
    hashes, places = ld.word_hashes(text.encode())
    whole = [w for w in re.split(r"[ \n]+", text) if w]
    assert len(set(zip(whole, hashes.tolist()))) == len(set(whole)) == len(set(hashes.tolist()))
    assert [text.encode()[p:].split(None, 1)[0].decode() for p in places] == whole
    rows = ld.token_rows(text.encode(), np.zeros(ld.CELLS, np.uint8))
    assert rows["line"].tolist() == [0, 2, 3, 4] and rows["n"].tolist() == [3, 3, 3, 3]
    assert rows["s"][0] == rows["s"][3] and len(set(rows["s"].tolist())) == 3
    assert ld.token_rows(b"\n \n", np.zeros(ld.CELLS, np.uint8))["line"].tolist() == []


def test_long_lines(spark):
    words = [f"w{k}" for k in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[40_000:])), (3, " ".join(words[100_000:]))]
    got = ld.later_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [tuple(r) for r in got if r.doc_id == 2] == [(2, 0, 1, 0)] and {r.doc_id for r in got} == {2, 3}


def test_removed_lines_are_not_paired_with_each_earlier_one(spark, monkeypatch):
    base = [f"w{k}" for k in range(40)]
    early = [[f"e{i}x{k}" if k // 5 == i else w for k, w in enumerate(base)] for i in range(8)]  # similar to base, not to one another
    rows = [(k, " ".join(own)) for k, own in enumerate(early + [[*base, f"own{k}"] for k in range(150)])]
    sizes, keep = [], ld.stored

    def counted(df, name):
        out = keep(df, name)
        if name in ("met", "pairs"):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(ld, "stored", counted)
    got = ld.later_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line_no) for r in got} == brute(rows) == {(k, 0) for k in range(8, 158)}
    assert sum(sizes) <= 3 * len(rows)


def test_near_copies_are_compared_once_each(spark, monkeypatch):
    rnd = random.Random(4)
    rows = []
    for k in range(300):
        own = [f"w{i}" for i in range(45)]
        for i in rnd.sample(range(45), 3):
            own[i] = f"own{k}x{i}"
        rows.append((k, " ".join(own)))
    compared = "compared" if hasattr(ld, "_similar") else "pairs"
    sizes, keep = [], ld.stored

    def counted(df, name):
        out = keep(df, name)
        if name == compared:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(ld, "stored", counted)
    got = ld.later_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line_no) for r in got} == brute(rows) == {(k, 0) for k in range(1, 300)}
    assert sum(sizes) <= 3 * len(rows)


def test_no_python_on_executors(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda *_: 1 / 0)
    rows = corpus(20, 7) + EDGES
    got = ld.later_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line_no) for r in got} == brute(rows)
