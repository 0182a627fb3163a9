import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm import language_id as li

WORDS = {"en": "the and that with from have this which their about", "de": "der und die das nicht ist mit auch eine werden", "fr": "le et les des dans pour que une avec est"}


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(k, " ".join((w := WORDS[lang].split())[k % 7 :] + w[: k % 5]), lang) for k, lang in enumerate(list(WORDS) * 40)]
    rows += [(900, None, "en"), (901, "nothing", None), (None, "xx", "en"), (902, "", "de")]
    return li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_known_and_unseen_words(learned):
    assert learned.languages == ["de", "en", "fr"]
    assert learned.predict("that which THE")[0] == "en"
    assert learned.predict("thatwith theirs")[0] == "en"
    assert learned.predict("werdennicht einer")[0] == "de"


def test_backoff_takes_the_longest_known_length():
    import numpy as np

    grams = [{} for _ in range(li.LONGEST)]
    grams[0] = {"a": np.array([0.0, -9.0])}
    grams[2] = {"abc": np.array([-9.0, 0.0])}
    model = li.LanguageModel(["x", "y"], {"b": np.array([0.0, -1.0])}, grams)
    assert model.predict("abcd")[0] == "y" and model.predict("ad")[0] == "x" and model.predict("b")[0] == "x"
    assert model.predict("zzz") == ("x", 0.5)


def test_rows_of_every_kind(spark, learned):
    rows = [(1, None), (2, ""), (3, "12 ²³ !!"), (None, "the and"), (4, "der und " * 200_000), (4, "der und")]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, score string")
    got = {(r.doc_id, r.lang_pred) for r in li.predict(docs, learned).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "de")}
    for r in li.predict(docs, learned).collect():
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    kept = li.keep_identified(docs, learned)
    assert kept.columns == docs.columns and kept.count() == 3


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string, lang string"))
    model = li.fit(empty)
    assert li.predict(empty, model).count() == 0
    assert model.predict("words") == ("und", 0.0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.predict(docs, li.fit(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).head()[0] > 0.97


def test_fit_and_predict_against_plain_counts(spark):
    """The documents that may teach, counted with dictionaries, and every text scored word by word."""
    from collections import Counter
    from math import exp, log

    import regex

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    words, grams = Counter(), [Counter() for _ in range(li.LONGEST)]
    for doc_id, text, lang in rows:
        if text is None or lang is None or zlib.crc32(str(doc_id).encode()) % 3 == 1:
            continue
        for word in regex.findall(r"\p{L}+", text.lower()):
            words[word, lang] += 1
            marked = f"^{word}$"
            for n in range(1, li.LONGEST + 1):
                for at in range(len(marked) - n + 1):
                    grams[n - 1][marked[at : at + n], lang] += 1
    languages = sorted({lang for _, lang in words})

    def logs(counts):
        names, totals = {name for name, _ in counts}, Counter()
        for (_, lang), n in counts.items():
            totals[lang] += n
        return names, lambda name, lang: log((counts[name, lang] + 0.5) / (totals[lang] + len(names) * 0.5 + 1))

    known, own = logs(words)
    tables = [logs(g) for g in grams]

    def scored(word):
        if word in known:
            return [own(word, lang) for lang in languages]
        marked = f"^{word}$"
        for n in range(min(li.LONGEST, len(marked)), 0, -1):
            names, table = tables[n - 1]
            parts = [marked[at : at + n] for at in range(len(marked) - n + 1) if marked[at : at + n] in names]
            if parts:
                return [sum(table(p, lang) for p in parts) / len(parts) for lang in languages]
        return [0.0] * len(languages)

    cache = {}
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in li.predict(docs, li.fit(docs, rows_per_language=10**9)).collect()}
    for doc_id, text, _ in rows:
        total = [0.0] * len(languages)
        seen = regex.findall(r"\p{L}+", (text or "").lower())
        for word in seen:
            if word not in cache:
                cache[word] = scored(word)
            total = [a + b for a, b in zip(total, cache[word])]
        if not seen:
            assert found[doc_id] == ("und", 0.0)
            continue
        odds = [exp(t - max(total)) for t in total]
        lang, score = found[doc_id]
        assert abs(score - max(odds) / sum(odds)) < 1e-3 and odds[languages.index(lang)] > 0.999
