"""BM25 with bounds against plain scores, whatever the shards and thresholds; segments; substring joins; pairs at the limit."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rankweave.operators.checks import containing, similar_pairs
from rankweave.operators.lexical import bm25_rank, bm25_scores, build_index, compacted, cut, extended, without
from rankweave.operators.substrings import Q, holding


def plain_ranks(docs, queries, k):
    lists = [cut((text or "").lower()) for _, _, text in docs]
    n, mean = len(docs), sum(map(len, lists)) / len(docs)
    df = Counter(t for words in lists for t in set(words))
    idf = {t: math.log((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    found = []
    for qid, text in queries:
        scores = []
        for (id_, pos, _), words in zip(docs, lists):
            tf = Counter(words)
            score = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(words) / mean)) for t in cut((text or "").lower()) if tf[t])
            if round(score, 6) > 0:
                scores.append((-round(score, 6), pos, id_))
        found += [(qid, id_, -score, r) for r, (score, _, id_) in enumerate(sorted(scores)[:k], 1)]
    return found


def made(seed, docs, longest):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(3000)]
    return [(f"d{k}", k, " ".join(rng.choices(words, k=rng.randint(0, longest)))) for k in range(docs)] + [("null", docs, None)]


def same(got, expected):
    got = sorted((tuple(r) for r in got), key=lambda r: (r[0], r[3]))
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in sorted(expected, key=lambda r: (r[0], r[3]))]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, sorted(expected, key=lambda r: (r[0], r[3]))))


@pytest.mark.parametrize(("parts", "leading"), [(1, 32), (40, 0)])
def test_bounds_leave_out_nothing_that_ranks(spark, parts, leading):
    docs = made(1, 400, 60)
    rng = random.Random(2)
    queries = [(q, " ".join(rng.choice(docs[:-1])[2].split()[: rng.randint(1, 40)])) for q in range(25)] + [(90, "w1 w1 w2"), (91, None), (92, "unknown")]
    index = build_index(spark.createDataFrame(docs, "id string, pos long, text string").repartition(parts))
    asked = spark.createDataFrame(queries, "qid long, text string")
    for k in (1, 5, 20):
        same(bm25_rank(index, asked, k, leading).collect(), plain_ranks(docs, queries, k))
    assert bm25_scores(index, asked).count() == len(plain_ranks(docs, queries, 10_000))


def test_segments_rank_like_one_index(spark):
    docs, more = made(3, 120, 30)[:-1], made(4, 60, 30)[:-1]
    schema = "id string, pos long, text string"
    first, second, third = docs[:100], more[:30], [("d3", 500, "w1 w2 new"), ("d101", 501, "w1 again")]
    second = [(f"e{k}", 200 + k, text) for k, (_, _, text) in enumerate(second)]
    index = build_index(spark.createDataFrame(first, schema))
    index = extended(index, spark.createDataFrame(second, schema))
    index = extended(without(index, spark.createDataFrame([("d5",), ("e2",), ("none",)], "id string")), spark.createDataFrame(third, schema))
    whole = [d for d in first + second if d[0] not in ("d5", "e2", "d3")] + third
    queries = [(k, whole[k][2]) for k in range(0, len(whole), 9)]
    asked = spark.createDataFrame(queries, "qid long, text string")
    expected = plain_ranks(whole, queries, 7)
    same(bm25_rank(index, asked, 7).collect(), expected)
    assert index.segments == 3
    same(bm25_rank(compacted(index), asked, 7).collect(), expected)
    same(bm25_rank(build_index(spark.createDataFrame(whole, schema)), asked, 7).collect(), expected)


def test_an_empty_index_finds_nothing(spark):
    empty = build_index(spark.createDataFrame([], "id long, pos long, text string"))
    asked = spark.createDataFrame([(1, "a b")], "qid long, text string")
    assert bm25_rank(empty, asked).count() == 0
    filled = extended(empty, spark.createDataFrame([(1, 1, "a c"), (2, 2, "d"), (3, 3, "e")], "id long, pos long, text string"))
    assert [r["id"] for r in bm25_rank(filled, asked).collect()] == [1]


def test_terms_of_any_length_are_found_where_they_are(spark):
    rng = random.Random(5)
    letters = "abä\U0001f600 \n天3"
    texts = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))) for k in range(80)] + [(1000, None), (1001, "")]
    terms = []
    for t in range(120):
        source = rng.choice(texts[:80])[1]
        at = rng.randint(0, max(0, len(source) - 1))
        terms.append((t, source[at : at + rng.randint(0, 2 * Q)] if t % 3 else "".join(rng.choice(letters) for _ in range(rng.randint(1, 5)))))
    terms += [(500, None), (501, "")]
    frames = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(terms, "term_id long, term string")
    expected = {(t, k) for t, term in terms for k, text in texts if term and text is not None and term in text}
    assert {tuple(r) for r in holding(*frames).collect()} == expected
    fold = lambda x: "".join((x or "").split())
    assert {tuple(r) for r in containing(*frames).collect()} == {(t, k) for t, term in terms for k, text in texts if fold(term) and fold(term) in fold(text)}
    assert holding(frames[0].limit(0), frames[1]).count() == 0 and holding(frames[0], frames[1].limit(0)).count() == 0
    plan = holding(*frames)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pairs_exactly_at_the_limit(spark):
    letters = [chr(0x4E00 + k) for k in range(3000)]
    # sets of bigrams by text: a text of n + 1 different letters has n bigrams; two texts share their common run
    rows, expected, at = [], defaultdict(float), 0
    for union in (20, 40, 100, 200, 380, 400):
        for shared in (union * 55 // 100 - 1, union * 55 // 100, union * 55 // 100 + 1):
            rest = union - shared
            left, right = rest // 2, rest - rest // 2
            run = letters[: shared + 1]
            a = "".join(run) + "".join(letters[1000 : 1000 + left])
            b = "".join(run) + "".join(letters[2000 : 2000 + right])
            grams = lambda x: {x[k : k + 2] for k in range(len(x) - 1)}
            rows += [(at, a), (at + 1, b)]
            at += 2
    texts = dict(rows)
    for i in texts:
        for j in texts:
            if i < j:
                x, y = grams(texts[i]), grams(texts[j])
                if len(x & y) / len(x | y) >= 0.55:
                    expected[i, j] = round(len(x & y) / len(x | y), 6)
    found = similar_pairs(spark.createDataFrame(rows, "id long, text string"))
    assert {(r["left_id"], r["right_id"]): r["similarity"] for r in found.collect()} == dict(expected)
    assert any(v == 0.55 for v in expected.values())
