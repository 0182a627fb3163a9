import hashlib
import random

import duckdb
from pyspark.sql import types as T

from rankweave.llm import chat

SCHEMA = "tree long, node long, parent long, score double, role string, text string"


def best_paths(rows):
    """By walking every leaf up."""
    out = {}
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        parents = {r[2] for r in own.values()}
        found = []
        for leaf in own:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][2]
            if at not in path:
                total = sum(round(own[x][3] or 0, 6) for x in path)
                found.append((-round(total, 6), -len(path), leaf, path[::-1]))
        if found:
            out[tree] = min(found)[-1]
    return out


def test_trees_against_walking(spark):
    rnd, rows = random.Random(2), []
    for tree in range(30):
        for node in range(rnd.choice([1, 2, 5, 12, 40])):
            parent = rnd.randrange(node) if node and rnd.random() < 0.9 else rnd.choice([None, 99])
            rows.append((tree, node, parent, rnd.choice([None, 1.0, 0.5, -2.0]), "user", f"{tree}-{node}"))
    rows += [(50, 1, 2, 1.0, "user", "on a cycle"), (50, 2, 1, 1.0, "user", "on a cycle"), (51, 1, 1, 1.0, "user", "own parent")]
    rows += [(60, n, n - 1 if n else None, 1.0, "user", str(n)) for n in range(100)]
    got = chat.format_paths(spark.createDataFrame(rows, SCHEMA))
    turns = {r.tree: [t.text for t in r.turns] for r in chat.read_back(got).collect()}
    assert turns == {tree: [f"{tree}-{n}" if tree < 50 else str(n) for n in path] for tree, path in best_paths(rows).items()}


def test_round_trip_of_awkward_texts(spark):
    texts = [None, "", chat.START, chat.END, chat.MIDDLE, "\\", "<\\", "\\<", "[INST]\\n", "<<[[\\\\<|im_end|>\n", "a\nb", "é🙂<|im_sep|>", "</s>[INST] ok [/INST]", "x" * 300_000]
    rows = [(k, 0, None, 1.0, t, None) for k, t in enumerate(texts[:-1])] + [(100 + k, 0, None, 1.0, "assistant", t) for k, t in enumerate(texts)]
    rows += [(1000, n, n - 1 if n else None, 1.0, ["user", "assistant"][n % 2], t) for n, t in enumerate(texts)]
    got = {r.tree: r for r in chat.read_back(chat.format_paths(spark.createDataFrame(rows, SCHEMA))).collect()}
    for k, t in enumerate(texts[:-1]):
        assert got[k].turns[0].role == (t or "") and got[k].loss_text == ""
    for k, t in enumerate(texts):
        assert got[100 + k].turns[0].text == (t or "") and got[100 + k].loss_text == (t or "")
        assert got[100 + k].formatted.count(chat.END) == 1
    assert [t.text for t in got[1000].turns] == [t or "" for t in texts]
    assert got[1000].loss_text == "".join(t or "" for t in texts[1::2])


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, chat.op9_chat_formatting(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    assert got == sorted(con.execute(chat.OP9_SQL).fetchall())
    ok = "</s>[INST] ok [/INST]"
    assert got[0][:3] == (-7, 2, hashlib.sha256(f"user\n{ok}\nassistant\n{ok}\n".encode()).hexdigest()) and got[0][3] == len(ok)


def test_empty_table(spark):
    assert chat.format_paths(spark.createDataFrame([], T.StructType.fromDDL(SCHEMA))).count() == 0


def test_messages_of_a_null_tree_are_one_tree(spark):
    rows = [(None, 1, None, 0.0, "user", "hi"), (None, 2, 1, 1.0, "assistant", "yes"), (None, 3, 1, 0.0, "assistant", "no"), (5, 1, None, 0.0, "user", "other")]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    assert sorted(map(str, ((r.tree, r.node, r.depth) for r in chat.chosen_paths(messages).collect()))) == ["(5, 1, 1)", "(None, 1, 1)", "(None, 2, 2)"]
    got = {r.tree: (r.n_turns, r.loss_text) for r in chat.read_back(chat.format_paths(messages)).collect()}
    assert got == {None: (2, "yes"), 5: (1, "")}


def test_query_and_sql_agree_on_a_null_conversation(spark, tmp_path):
    rows = [(None, 0, "user", "a [b"), (None, 1, "assistant", "c"), (1, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, chat.op9_chat_formatting(spark, str(tmp_path)).collect()))) == sorted(map(str, con.execute(chat.OP9_SQL).fetchall()))


def test_messages_that_share_a_node_have_one_place_in_any_order(spark):
    rows = [(1, 1, None, 0.0, "user", "root"), (1, 2, 1, 1.0, "assistant", "a"), (1, 2, None, 2.0, "assistant", "b"), (1, 3, 2, 1.0, "user", "end")]
    shown = [chat.format_paths(spark.createDataFrame(r, "tree long, node long, parent long, score double, role string, text string")).collect() for r in (rows, rows[::-1])]
    assert [tuple(r) for r in shown[0]] == [tuple(r) for r in shown[1]] and len(shown[0]) == 1
