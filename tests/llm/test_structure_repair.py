"""Repairs of conversations against SQL, an exhaustive search, and themselves in pieces."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from rankweave.llm.structure_repair import END, OP11_SQL, audited, checkpoints, damaged, op11_structure_repair, walk

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def searched(rows):
    """(cost, letters, lines) by a search over all edit scripts, cheapest and then ASCII-least first."""
    seen, queue = set(), [(0, "", 0, "", ())]
    while queue:
        cost, letters, at, roles, lines = heapq.heappop(queue)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters, lines
        if (at, roles[-1:], letters) in seen or not re.fullmatch("(s?(ua)*u?)?", roles):
            continue
        seen.add((at, roles[-1:], letters))
        step = []
        if at < len(rows):
            role, text, fault = rows[at]
            step.append((3, "D", 1, "", ()))
            if fault in ("", "truncated"):
                worn = fault == "truncated"
                step.append((worn, "K", 1, role[:1] or "?", (f"{role}:{text}",)))
                step += [(2 + worn, "R", 1, r[0], (f"{r}:{text}",)) for r in ("user", "assistant")]
        step += [(2, "I", 0, r[0], (f"{r}:",)) for r in ("user", "assistant")]
        for more, letter, on, role, line in step:
            if cost + more <= 3 * len(rows):
                heapq.heappush(queue, (cost + more, letters + letter, at + on, roles + role, lines + line))


def faults(rows):
    found, seen = [], set()
    for role, text in rows:
        visible = text.strip(" \t\n\x0b\x0c\r")
        found.append((role, text, "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""))
        seen.add((role, text))
    return found


def compared(spark, rows, bits=16):
    frame = spark.createDataFrame(rows, SCHEMA)
    return {r["conv_id"]: r for r in audited(frame, frame, bits).collect()}


def made(seed, convs, most):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "user", "assistant", "assistant", "system", "tool", ""]), rng.choice(["a.", "b.", "c.", "d!", "e", "", " \n"])) for c in range(convs) for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("bits", [16, 1])
def test_cheapest_and_least_of_all_scripts(spark, bits):
    rows = made(7, 40, 5)
    found = compared(spark, rows, bits)
    for conv in range(40):
        own = faults([(role, text) for c, _, role, text in sorted(rows) if c == conv])
        cost, letters, lines = searched(own)
        row = found[conv]
        assert (row["cost"], row["audit"], row["repaired_sha256"]) == (cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()), own
        assert [row[k] for k in ("blank", "duplicate", "truncated")] == [sum(f == k for _, _, f in own) for k in ("blank", "duplicate", "truncated")]
        assert row["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))


def test_pieces_agree_with_whole_conversations(spark):
    rows = made(11, 6, 300)
    columns = lambda found: sorted(tuple(r) for r in found.values())
    assert columns(compared(spark, rows)) == columns(compared(spark, rows, 2))


def test_vectors_are_kept_at_checkpoints_alone():
    codes = [random.Random(3).randrange(16) for _ in range(10_000)]
    assert len(checkpoints(codes, END, 100)) == 100
    whole = walk(codes, END, [0], True)[0][1]
    assert whole == [e for e in whole if e.letter in "DIKR"] and sum(e.letter != "I" for e in whole) == 10_000


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    relation = con.execute(OP11_SQL)
    names = [d[0] for d in relation.description]
    got = op11_structure_repair(spark, SF)
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == sorted(relation.fetchall())


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "One. Two? Three!") for c in range(30) for t in range(4)]
    got = sorted(tuple(r) for r in damaged(spark.createDataFrame(rows, SCHEMA)).collect())
    expected = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else "One Two Three" if kind == 2 else text)
        expected += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(expected)


def test_nulls_ties_long_texts_extra_names_and_empty_tables(spark):
    rows = [(None, None, None, None, 1), (None, 2, "user", "x.", 1), (5, None, "user", "q.", 1), (5, 1, "assistant", "a. " * 400_000, 1), (5, 1, "assistant", "a. " * 400_000, 1), (6, 3, "user", "?", 1)]
    frame = spark.createDataFrame(rows, SCHEMA + ", `a.b` int")
    found = {r["conv_id"]: r for r in audited(frame.where("conv_id is null or conv_id < 6"), frame).collect()}
    assert set(found) == {None, 5, 6}
    assert (found[None]["gaps"], found[None]["blank"], found[None]["audit"]) == (0, 1, "DKI")
    assert (found[5]["duplicate"], found[5]["audit"], found[5]["cost"]) == (1, "KKD", 3)
    assert tuple(found[6])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert audited(frame.limit(0), frame.limit(0)).count() == 0
