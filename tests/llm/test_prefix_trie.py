"""Prefix tries against SQL, plain dictionaries, and themselves under other shard sizes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from rankweave.llm.prefix_trie import OP12_SQL, DoubleArray, op12_prefix_trie, prefix_nodes, rebuilt, trie_nodes

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The contract with dictionaries of tuples."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members, below = defaultdict(list), defaultdict(set)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                below[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    found = []
    for node in members:
        inside = [n for n in members if n[: len(node)] == node]
        words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        ends = ",".join(str(c) for c in sorted(members[node]) if len(whole[c]) == len(node))
        found.append((
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below[node]),
            sum(not below[n] for n in inside), sum((len(members[n]) - 1) * words(n) for n in inside), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(found, key=lambda r: (r[0], r[1]))


def made(seed, convs, most, texts="abc"):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), " ".join(rng.choice(texts) for _ in range(rng.randint(0, 2)))) for c in range(convs) for t in range(rng.randint(1, most))]


def nodes(spark, rows, *sizes, schema=SCHEMA):
    return sorted((tuple(r) for r in prefix_nodes(*rebuilt(spark.createDataFrame(rows, schema)), *sizes).collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("sizes", [(), (1, 1), (6, 1)])
def test_against_dictionaries_under_any_shard_size(spark, sizes):
    # every fourth conversation is one of a few copies; turns come from six texts, so prefixes are shared widely
    rows = made(5, 60, 6) + [(c, t, "user", "same words here") for c in range(100, 130) for t in range(7)]
    assert nodes(spark, rows, *sizes) == plain(rows)


def test_one_long_conversation_with_a_near_copy(spark):
    rows = [(40, t, "user", f"{t % 7} x") for t in range(400)] + [(60, t, "user", f"{t % 7} x") for t in range(390)] + [(60, 390, "user", "end")]
    assert nodes(spark, rows, 50, 4) == plain(rows)


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    relation = con.execute(OP12_SQL)
    names, expected = [d[0] for d in relation.description], relation.fetchall()
    got = op12_prefix_trie(spark, SF)
    assert got.columns == names
    order = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(expected, key=order)


def test_double_array_holds_its_sequences_and_no_others():
    rng = np.random.default_rng(1)
    sequences = list({tuple(rng.integers(1, 40, rng.integers(1, 9))) for _ in range(3000)})
    symbols = np.concatenate([np.array(s[1:], np.int64) for s in sequences])
    lengths = np.array([len(s) - 1 for s in sequences])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    trie, levels = trie_nodes(np.array([s[0] for s in sequences]), symbols, starts, lengths)
    prefixes = {s[:d] for s in sequences for d in range(1, 9) if len(s) >= d}
    assert sum(len(np.unique(at)) for _, at in levels) == len(prefixes)
    used = trie.check[1 : trie.last + 1] >= 0
    assert used.sum() == len(prefixes) and used.mean() > 0.5
    for _ in range(3000):
        walk, node = tuple(rng.integers(1, 40, rng.integers(1, 5))), np.zeros(1, np.int64)
        for symbol in walk:
            node = trie.step(node, np.array([symbol])) if node[0] >= 0 else node
        assert (node[0] >= 0) == (walk in prefixes)


def test_a_node_with_many_children_is_packed_without_gaps():
    trie = DoubleArray(4)
    trie.add(0, np.arange(1, 5001))
    assert trie.last == 5000 and (trie.step(np.zeros(5000, np.int64), np.arange(1, 5001)) == np.arange(1, 5001)).all()
    assert trie.step(np.zeros(2, np.int64), np.array([0, 5001])).tolist() == [-1, -1]


def test_nulls_ties_repeats_turnless_long_texts_extra_names_and_empty_tables(spark):
    rows = [(None, 1, "user", "lost"), (3, None, None, None), (3, 1, "user", "a"), (3, 1, "user", "a"), (3, 1, "assistant", "b"), (23, 0, "user", "x " * 300_000), (24, None, "user", None)]
    wide = [(*r, 1) for r in rows]
    assert nodes(spark, wide, schema=SCHEMA + ", `a.b` int") == plain(rows)
    assert nodes(spark, [], schema=SCHEMA) == []
    lone = [(c, 0, "user", "only") for c in range(1, 12)]  # those whose first turns are replaced by an absent lead have none
    assert nodes(spark, lone) == plain(lone)
