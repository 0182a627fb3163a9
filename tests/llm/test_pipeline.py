"""The corpus pipeline stage by stage, each against a plain version over its own input."""

import re
from collections import defaultdict

import corpus_pipeline
import pytest

from rankweave.llm import decontamination as dc
from rankweave.llm import mixing as mx
from tests.llm.test_mixing import levels
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "", "en", "src1", 0), (9003, "12 34 !!", "en", None, 8), (9004, docs.head().text + " end", "en", "src2", 0)], docs.schema)
    outputs = [docs.unionByName(extra).cache()]
    for _, stage in corpus_pipeline.STAGES:
        outputs.append(stage(spark, outputs[-1], SF).cache())
    return outputs


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID output"]
    assert all(s.schema.simpleString() == stages[0].schema.simpleString() for s in stages[:5])


def test_language_stage_drops_what_has_no_language(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[:2])
    assert {9001, 9002, 9003} <= before.keys() - after.keys() and all(after[d] == before[d] for d in after)
    assert len(after) >= 0.99 * len([r for r in before.values() if re.search("[^\\W\\d_]", r.text or "")])


def test_near_duplicates_leave_one_of_each(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(d for d, _, _, kept in brute(rows) if kept)


def test_no_passage_is_left_and_clean_documents_stay(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = dc.PassageIndex(items)
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    clean = [d for (d, _), m in zip(rows, dc.matches(index, [t for _, t in rows])) if not m]
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(clean)
    held = {d for d, t in rows for _, i in items if i in t}
    assert held and held.isdisjoint(clean)


def test_mix_meets_its_targets(stages):
    before, after = stages[3].collect(), stages[4].collect()
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    sizes, taken, times = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += size(r)
    for r in after:
        taken[r.source] += size(r)
        times[r.doc_id] += 1
    assert max(times.values()) <= mx.MOST
    for source, target in levels(dict(sizes)).items():
        assert abs(taken[source] - target) <= max(200, 0.1 * target)


def test_token_files_hold_all_rows(stages):
    rows = sorted(stages[5].collect(), key=lambda r: r.start)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stages[4].collect())
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_ids_of_the_token_files(spark, stages):
    """Every row of the last stage against the tokenizer as the library opens it."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(((r.doc_id, r.text) for r in stages[4].collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for (doc_id, text), got in zip(rows, sorted(stages[5].collect(), key=lambda r: r.start), strict=True):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_whole_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and 0 < got.count() <= 3 * stages[0].count()


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_extra_columns_of_any_name_and_type(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.selectExpr("*", "doc_id AS `a.b`", "map(lang, doc_id) AS tags", "named_struct('text', source) AS `x y`")
    wide = wide.unionByName(wide.where("doc_id = 1"))  # a repeated row with a map
    for _, stage in corpus_pipeline.STAGES[:4]:
        wide = stage(spark, wide, SF).cache()
        assert wide.columns == [*docs.columns, "a.b", "tags", "x y"] and wide.count() > 100
        assert wide.where("`a.b` <> doc_id OR tags[lang] <> doc_id OR `x y`.text <> source").isEmpty()
    assert corpus_pipeline.STAGES[4][1](spark, wide, SF).count() == wide.count()
