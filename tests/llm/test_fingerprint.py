import hashlib

import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm import fingerprint as fp

TOKEN = regex.compile(fp.TOKEN.replace(r"\p{Is", r"\p{"))


def plain_slots(spark, texts):
    """The same by the book: number the occurrences, order the elements on the ring, walk on from each point."""
    hashes = {}
    tokens = {t: TOKEN.findall(t) for t in texts}
    words = sorted({w for ws in tokens.values() for w in ws})
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect():
        hashes[r.w] = r.h
    rows = [(t, i, *([hashes[w] for w in ws[i : i + fp.K]] + [None] * fp.K)[: fp.K]) for t, ws in tokens.items() for i in range(max(len(ws) - fp.K + 1, min(1, len(ws))))]
    names = [f"h{k}" for k in range(fp.K)]
    mask = ~((1 << fp.PLACE_BITS) - 1)
    kmers = spark.createDataFrame(rows, "t string, i int, " + ", ".join(f"{n} long" for n in names)).select("t", "i", F.xxhash64(*names).alias("h")).collect()
    numbered, seen = [], {}
    for r in sorted(kmers, key=lambda r: (r.t, r.i)):
        n = seen[r.t, r.h & mask] = seen.get((r.t, r.h & mask), -1) + 1
        numbered.append((r.t, r.i, r.h & mask, n))
    again = spark.createDataFrame(numbered, "t string, i int, h long, n int").select("t", "i", F.when(F.col("n") == 0, F.col("h")).otherwise(F.xxhash64("h", "n").bitwiseAND(F.lit(mask))).alias("h")).collect()
    out = []
    for t in texts:
        ring = sorted((r.h, r.i) for r in again if r.t == t)
        for k in range(fp.SLOTS if ring else 0):
            point = (k << 58) - (1 << 63)
            at = next((x for x, (h, _) in enumerate(ring) if h >= point), 0)
            pair = sorted([ring[at], ring[(at + 1) % len(ring)]], key=lambda e: e[1])
            out.append((t, k, pair[0][0], pair[1][0]))
    found = {(r.t, r.k): r.v for r in spark.createDataFrame(out, "t string, k int, a long, b long").select("t", "k", F.hash("a", "b").alias("v")).collect()}
    return {t: [found.get((t, k), 0) for k in range(fp.SLOTS)] for t in texts}


def test_slots_against_plain_version(spark):
    texts = ["", "a", "a b", "a b c", "no no no no no no", "the cat sat on the mat and the cat sat on the hat " * 3, "中文没有空格的文字" * 4, "x" * 200, "a\n\nb \t c", "Émile 🙂 said: été"] + [" ".join(str(k * j % 17) for k in range(j)) for j in range(2, 60, 7)]
    texts = list(dict.fromkeys(texts))
    got = {r.t: list(r.f) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", fp.fingerprint(F.col("t")).alias("f")).collect()}
    assert got == plain_slots(spark, texts)


def test_edited_texts_and_neighbours(spark):
    rows = [(k * 3, "".join(chr(97 + (k * j) % 26) + ("" if j % 5 else " ") for j in range(k))) for k in range(1, 60)] + [(7, None), (8, ""), (None, "no id at all"), (3, "tie one"), (3, "tie one"), (3, None)]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, key string").repartition(4)
    got = [r.asDict() for r in fp.fingerprints(docs).collect()]
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t in ordered]
    expected = []
    for k, (doc_id, _) in enumerate(ordered):
        own, after = texts[k], texts[(k + 1) % len(texts)]
        cut = len(own) // 3
        expected.append((doc_id, len(own), hashlib.sha256((own[: len(own) - cut] + after[:cut]).encode()).hexdigest()))
    assert sorted(map(str, ((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got))) == sorted(map(str, expected))
    assert all(len(r["fingerprint"]) == 8 * fp.SLOTS and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_likeness_falls_with_edits_and_rearrangement(spark):
    words = [f"w{k * 7919 % 997}" for k in range(400)]
    texts = {"same": words, "tenth": words[:360] + ["x"] * 40, "third": words[:267] + ["y"] * 133, "turned": words[200:] + words[:200], "other": [f"z{k}" for k in range(400)]}
    base = fp.fingerprint(F.lit(" ".join(words)))
    rows = spark.createDataFrame([(n, " ".join(t)) for n, t in texts.items()], "n string, t string")
    near = {r.n: r.v for r in rows.select("n", fp.likeness(base, fp.fingerprint(F.col("t"))).alias("v")).collect()}
    assert near["same"] == 1 and near["other"] == 0
    assert 1 > near["tenth"] > near["third"] > 0 and near["turned"] < 0.75


def test_long_text_single_document_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "word and word " * 60_000)], "doc_id long, text string")
    row = fp.fingerprints(docs).head()
    assert row.n_chars == 840_000 and row.near_next == 1
    assert fp.fingerprints(spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string"))).count() == 0


def test_one_inserted_character_changes_little_in_texts_without_spaces(spark):
    solid = "".join(chr(97 + (k * k * 31 + k * 7) % 26) if k % 3 else str(k % 10) for k in range(600))
    khmer = "".join(chr(0x1780 + (k * k * 13 + k) % 34) for k in range(600))
    rows = [(n, t, t2) for n, t in (("solid", solid), ("khmer", khmer)) for t2 in ("x" + t, t[:300] + "q" + t[300:], t[1:])]
    near = spark.createDataFrame(rows, "n string, a string, b string").select("n", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("v")).collect()
    assert min(r.v for r in near) > 0.7


def test_many_rows_without_an_id(spark):
    rows = [(None, f"text number {k % 40} of many") for k in range(80)] + [(4, "with an id")]
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 81 and sum(r.doc_id is None for r in got) == 80


def test_places_beyond_the_bits_are_taken_in_steps(spark, monkeypatch):
    monkeypatch.setattr(fp, "PLACE_BITS", 8)
    monkeypatch.setattr(fp, "_PLACE", 255)
    monkeypatch.setattr(fp, "_HASH", ~255)
    text = " ".join(str(k * 7919 % 9973) for k in range(800))
    a, b = spark.createDataFrame([(text, text.replace("7919 ", "x "))], "a string, b string").select(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).head()
    assert sum(x == y for x, y in zip(a, b)) > 50


def test_tokens_without_lookups_of_scripts_are_the_same(spark):
    texts = ["".join(map(chr, range(1, 0x250))), "".join(chr(k) for k in range(0x250, 0x11000, 37) if not 0xD800 <= k < 0xE000), "bcdfghjkbcdfghj e\tbcdfghje  xa 中b中　かก🙂🙂a", "b" * 50 + "e" * 9, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", F.regexp_extract_all("t", F.lit(fp._FAST_TOKEN), 0).alias("fast"), F.regexp_extract_all("t", F.lit(fp.TOKEN), 1).alias("plain")).collect()
    assert len(rows) == 5 and all(r.fast == r.plain and "".join(r.fast) == r.t for r in rows)


def test_few_elements_of_a_text_are_sorted_again(spark):
    own = [k * 7919 % 65536 - 32768 << 48 | k for k in range(5000)]
    twice = [x & fp._HASH | 6000 + k for k, x in enumerate(own[:30])]
    ring = spark.createDataFrame([(sorted(own + twice),)], "e array<long>").select(fp._ring(F.col("e")).alias("r")).head().r
    assert ring == sorted(ring) and len(ring) == 2 * fp.SLOTS + 30
    assert set(ring) & set(own) == {x for b in range(-32, 32) for x in sorted(o for o in own if o >> 58 == b)[:2]}
