import random
import re

import numpy as np
from pyspark.sql import types as T

from rankweave.llm import near_dedup as nd
from rankweave.llm.components import components


def brute(rows):
    def words(text):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 75 * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return {(d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, label)}


def corpus(seed=3, n=220):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = rnd.choices(vocab, k=40)
    rows = []
    for k in range(n):
        if rows and rnd.random() < 0.6:
            words = (rnd.choice(rows[:25])[1] or "x").split(" ")[:]
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
        else:
            words = rnd.choices(vocab, k=rnd.choice([1, 3, 4, 5, 8, 30, 90, 300]))
            if rnd.random() < 0.4:
                words += passage
        rows.append((1000 - k, " ".join(words)))
    return rows


def test_against_brute_force(spark):
    rows = corpus() + [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "A b C d E f"), (5004, "a B c D e F"), (5005, "É b c"), (5006, "é b c")]
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, kept int").repartition(5)
    assert set(map(tuple, nd.near_duplicates(docs).collect())) == brute(rows)


def test_lists_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 3000)
    rows = corpus(8, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert set(map(tuple, nd.near_duplicates(docs).collect())) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(2, text), (2, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted(map(str, map(tuple, nd.near_duplicates(docs).collect())))
    assert got == sorted(map(str, [(2, 2, 1, False), (2, 2, 1, False), (1, 2, 1, True), (None, 2, 1, True), (None, 0, None, True)]))
    assert nd.keep_one_of_each(docs).count() == 3
    two = spark.createDataFrame([(2, "b text of five words here", "y"), (2, "a text of other six words here", "z"), (2, "a text of other six words here", "x")], "doc_id long, text string, source string")
    assert [tuple(r) for r in nd.keep_one_of_each(two.repartition(3)).collect()] == [(2, "a text of other six words here", "x")]


def test_many_near_copies_with_bridges(spark):
    """A chain of texts, each near the next alone, beside a star of near copies."""
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(words[12 * k : 12 * k + 150])) for k in range(12)]
    rnd = random.Random(4)
    for k in range(120):
        own = [f"v{i}" for i in range(100)]
        for _ in range(3):
            own[rnd.randrange(100)] = f"x{k}{rnd.random()}"
        rows.append((100 + k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert set(map(tuple, nd.near_duplicates(docs).collect())) == brute(rows)


def test_similar_as_sets():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rnd.integers(0, 1 << 60, rnd.integers(1, 400)))
        b = np.unique(np.concatenate([rnd.choice(a, rnd.integers(1, len(a) + 1), replace=False), rnd.integers(0, 1 << 60, rnd.integers(0, 40))]))
        both = len(np.intersect1d(a, b))
        assert nd.similar(a, b) == (100 * both >= 75 * len(np.union1d(a, b)))


def test_empty_table(spark):
    docs = spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string"))
    assert nd.near_duplicates(docs).count() == 0


def test_components_of_a_path(spark):
    links = spark.range(1, 200).selectExpr("id as a", "id - 1 as b")
    got = components(links)
    assert got.count() == 200 and got.where("label <> 0").count() == 0


def test_long_text_sets():
    words = np.random.default_rng(0).integers(0, 10**6, 300_000)
    assert len(nd.shingles(" ".join(map(str, words)))) == 299_996
