import io
import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from rankweave.llm import token_output as to

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return to.UnitEncoder(PATH, kept=50)


@pytest.fixture(scope="module")
def plain():
    """A tokenizer as the library opens it."""
    return Tokenizer.from_file(PATH)


def whole(plain, text):
    return plain.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t.,'s1éAb　\x1c\x85")), max_size=60))
@settings(max_examples=400, deadline=None)
def test_words_encode_as_whole_text(encoder, plain, text):
    assert encoder.encode(text).tolist() == whole(plain, text)


@given(st.text(alphabet=" \n\n  .,'sé1aZ<|", max_size=40))
@settings(max_examples=600, deadline=None)
def test_runs_of_white_space(encoder, plain, text):
    assert encoder.encode(text).tolist() == whole(plain, text)


@given(st.text(alphabet="aAbzéÀÿØß,.!", min_size=1, max_size=12))
@settings(max_examples=400, deadline=None)
def test_words_and_marks(encoder, plain, text):
    for shown in (text, f" {text} {text}", f"x {text}\n{text}"):
        assert encoder.encode(shown).tolist() == whole(plain, shown)


def test_units_are_forgotten(encoder, plain):
    texts = [f"word{k % 70} {'x ' * (k % 5)}\n\nend{k % 11}, <|endoftext|>" if k % 9 == 0 else f"word{k % 70}, and {k}\n\n  more " for k in range(400)] + [None, ""]
    assert [encoder.encode(t).tolist() for t in texts] == [whole(plain, t or "") for t in texts]


def test_another_kind_of_tokenizer_encodes_whole(tmp_path, plain):
    plan = json.loads(plain.to_str())
    plan["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "t.json").write_text(json.dumps(plan))
    own = to.UnitEncoder(str(tmp_path / "t.json"))
    assert not own.by_units
    assert own.encode("Some Words here").tolist() == Tokenizer.from_file(str(tmp_path / "t.json")).encode("Some Words here", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["don't stop, we'll see", "a  b", "x\n\ny", "a \nb", "1st,2nd 3rd.", "été ña", "</s>[INST]<|endoftext|> ok", "中文 テスト", "a.\nB c", " lead", "trail ", "a,b c,d", "²x y²", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n", "a \n\n b", "\n", "  "])
def test_known_texts(encoder, plain, text):
    assert encoder.encode(text).tolist() == whole(plain, text)


@given(st.lists(st.lists(st.integers(0, 300), max_size=200), max_size=20), st.integers(5, 400))
@settings(max_examples=60, deadline=None)
def test_files_round_trip(docs, segment):
    sink = io.BytesIO()
    out = to.TokenFileWriter(sink, segment)
    for k, ids in enumerate(docs):
        out.add(k if k % 3 else None, np.array(ids, np.uint16))
    out.close()
    got = list(to.TokenFile(sink, out.at).ids_by_document())
    assert [d for d, _ in got] == [k if k % 3 else None for k in range(len(docs))]
    assert [ids.tolist() for _, ids in got] == docs


def test_any_block_decodes_alone_and_damage_is_noticed():
    ids = np.random.default_rng(1).zipf(1.3, 300_000).clip(0, 40_000).astype(np.uint32)
    sink = io.BytesIO()
    out = to.TokenFileWriter(sink)
    out.add(1, ids)
    out.close()
    file = to.TokenFile(sink, out.at)
    assert (file.blocks(0, 2, 3)[0] == ids[2 * to.BLOCK : 3 * to.BLOCK]).all()
    at = file.footer["segments"][0]["blocks"][1][0]
    raw = bytearray(sink.getvalue())
    raw[at + 5000] ^= 1
    with pytest.raises(ValueError):
        to.TokenFile(io.BytesIO(bytes(raw)), out.at).blocks(0, 1, 2)


def test_frequencies_fill_the_scale():
    for counts in ([1], [1, 10**9], list(range(1, 60_000)), [5] * 50_257):
        freq = to.quantised(np.array(counts))
        assert freq.sum() == to.SCALE and freq.min() >= 1


def test_documents(spark, plain):
    texts = ["hello world", "one <|endoftext|> two", None, "", "hello world", "Ünïcode \x1c text\n" * 50, "x" * 5000]
    rows = [(10 * k, t, "clash") for k, t in enumerate(texts)] + [(None, "no id", "clash"), (10, "tie", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    got = to.token_output(docs, PATH).collect()
    expected, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*whole(plain, text or ""), 0], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted(map(tuple, got), key=key) == expected


def test_empty_table(spark):
    docs = spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string"))
    assert to.token_output(docs, PATH).count() == 0
