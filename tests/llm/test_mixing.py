from collections import defaultdict

import pytest
from pyspark.sql import types as T

from rankweave.llm import mixing as mx


def levels(sizes):
    """Targets by filling up step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mx.WEIGHTS[k % 3] for k, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        left, w = total - sum(stopped.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w >= 3 * sizes[s]]
        if not over:
            return stopped | {s: left * weight[s] / w for s in free}
        stopped |= {s: 3.0 * sizes[s] for s in over}


def test_targets_copies_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(5000, None, "null source text " * 9), (5001, "zz", None), (5002, "zz", "one"), (None, "src1", "a b c"), (5003, "src1", "")], "doc_id long, source string, text string")
    rows = mx.mix(mx.sized_documents(docs.select("doc_id", "source", "text").union(extra))).collect()
    assert len(rows) == docs.count() + 5
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r.copies <= 3
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    for source, expected in levels(dict(sizes)).items():
        assert target[source] == pytest.approx(expected)
        assert abs(taken[source] - expected) <= max(30, 0.01 * expected), source
    again = mx.mix(mx.sized_documents(docs.select("doc_id", "source", "text").union(extra).repartition(7))).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_all_sources_alike(spark):
    docs = spark.createDataFrame([(k, "s", "w " * (k % 9 + 1)) for k in range(100)], "doc_id long, source string, text string")
    rows = mx.mix(mx.sized_documents(docs)).collect()
    assert {r.copies for r in rows} == {1}


def test_documents_come_as_often_as_taken(spark):
    docs = spark.createDataFrame([(k % 40, f"s{k % 4}", "w " * (k % 7), k, "x") for k in range(200)] + [(None, None, None, 0, "x")], "doc_id long, source string, text string, no long, size string")
    mixed = mx.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = mx.mix(mx.sized_documents(docs)).agg({"copies": "sum"}).head()[0]
    assert mixed.count() == copies


def test_empty_table(spark):
    docs = spark.createDataFrame([], T.StructType.fromDDL("doc_id long, source string, text string"))
    assert mx.mix(mx.sized_documents(docs)).count() == 0
    assert mx.mixed_documents(docs).count() == 0


def test_tilts_solve_the_dual(spark):
    """Each tilt by halving an interval."""
    from math import exp

    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sized = mx.sized_documents(docs)
    sources = mx.source_targets(sized)
    z = F.col("size") * F.col("docs") / F.col("source_size")
    tally = sized.join(sources, "source").where("size > 0").groupBy("sid", "size", "docs", "source_size").agg(F.count("*").alias("n")).select("sid", "size", "n", z.alias("z"))
    got = {r.sid: r.tilt for r in mx.tilts(tally, sources).collect()}
    target = {r.sid: r.target for r in sources.collect()}
    assert got
    for sid, tilt in got.items():
        rows = [r for r in tally.collect() if r.sid == sid]
        taken = lambda t: sum(r.n * r.size * min(3.0, exp(min(t * r.z, 2.0))) for r in rows)
        low, high = -200.0, 200.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (low, middle) if taken(middle) > target[sid] else (middle, high)
        assert taken(tilt) == pytest.approx(target[sid], rel=1e-6) and tilt == pytest.approx(low, abs=1e-3)
