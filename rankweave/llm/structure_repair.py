"""Cheapest repairs of conversations: a checkpointed dynamic program over pieces of each conversation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from rankweave.llm.common import small_batches
from rankweave.session import stored
from rankweave.sources.tables import spread, table

#: Costs of the edits, and of a truncated row that is not deleted. Keeping costs nothing.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A piece holds at most 2 to this power of rows of one conversation: what one call of the program works on.
PIECE_BITS = 16
FAR = 1 << 40
#: What the roles so far allow: nothing yet, a system turn, a user turn last, an assistant turn last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role a state asks for next, and the state after it.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Cheapest ends: a conversation may stop empty or after an assistant turn, else turns are inserted.
END = (0, 2 * INSERT, INSERT, 0)
#: A row's code: the place of its role's initial in this string (others: 3) plus four times its fault.
INITIALS = "sua"
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)


def _kept(state: int, initial: int) -> int | None:
    """The state after a row that keeps its role, where that is allowed."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 3 or NEXT[state] != (USER if initial == 1 else ASSISTANT):
        return None
    return NEXT[state]


def _moves(code: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a row as (letter, cost, state after), by letter."""
    fault, initial = divmod(code, 4)
    found = []
    for state in range(4):
        edits = [("D", DELETE, state)]
        if fault in (SOUND, CUT_OFF):
            worn = TRUNCATED if fault == CUT_OFF else 0
            if (kept := _kept(state, initial)) is not None:
                edits.append(("K", worn, kept))
            edits.append(("R", REROLE + worn, NEXT[state]))
        found.append(edits)
    return found


MOVES = [_moves(code) for code in range(16)]


def _back(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Cheapest costs of the rest in each state, before a row, from those after it."""
    s, y, u, a = (min(cost + after[to] for _, cost, to in edits) for edits in MOVES[code])
    u, a = min(u, INSERT + a), min(a, INSERT + u)
    return min(s, INSERT + u), min(y, INSERT + u), u, a


def _decoded(codes: str) -> list[int]:
    return [ord(c) - 97 for c in codes]


class Edit(NamedTuple):
    """An edit of the walk: its letter, the row it concerns (for an insertion the row it precedes) and the role it gives, if any."""

    letter: str
    at: int
    role: str | None


def checkpoints(codes: list[int], after: tuple[int, ...], block: int) -> list[tuple[int, ...]]:
    """Cost vectors at the ends of the blocks of ``block`` rows, first block first; no other vector is kept."""
    ends, costs = [], after
    for k in range(len(codes) - 1, -1, -1):
        if (k + 1) % block == 0 or k == len(codes) - 1:
            ends.append(costs)
        costs = _back(codes[k], costs)
    return ends[::-1]


def walk(codes: list[int], after: tuple[int, ...], states: list[int], last: bool) -> list[tuple[int, list[Edit]]]:
    """For each state before the first row: the state after the last one and the ASCII-least edits among the cheapest.

    ``after`` has the costs of what follows; where nothing does (``last``), turns are inserted until the roles may end.
    Vectors are kept at about the square root of the number of rows places and recomputed for one block at a time.
    """
    block = max(1, isqrt(len(codes)))
    ends = checkpoints(codes, after, block)
    now, edits = list(states), [[] for _ in states]
    for b, end in enumerate(ends):
        at, rows = b * block, codes[b * block : (b + 1) * block]
        costs = [end]
        for code in reversed(rows):
            costs.append(_back(code, costs[-1]))
        costs.reverse()
        for n, state in enumerate(now):
            out = edits[n]
            for k, code in enumerate(rows):
                while True:
                    rest = costs[k][state]
                    letter, to = min([(x, t) for x, c, t in MOVES[code][state] if c + costs[k + 1][t] == rest] + ([("I", NEXT[state])] if INSERT + costs[k][NEXT[state]] == rest else []))
                    out.append(Edit(letter, at + k, ROLE[to] if letter in "IR" else None))
                    state = to
                    if letter != "I":
                        break
            now[n] = state
    if last:
        for n, state in enumerate(now):
            while state not in (START, ASSISTANT):
                state = NEXT[state]
                edits[n].append(Edit("I", len(codes), ROLE[state]))
            now[n] = state
    return list(zip(now, edits))


@F.arrow_udf(StructType().add("costs", ArrayType(LongType())).add("illegal", LongType()).add("first", IntegerType()).add("last", IntegerType()))
def _through(pieces: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A piece as costs from each state before it to each state after it, its bad neighbours, and its outer initials."""
    for batch in pieces:
        out = []
        for text in batch.to_pylist():
            codes, costs = _decoded(text), []
            for goal in range(4):
                vector = tuple(0 if s == goal else FAR for s in range(4))
                for code in reversed(codes):
                    vector = _back(code, vector)
                costs.append(vector)
            illegal = sum((a % 4, b % 4) not in LEGAL for a, b in zip(codes, codes[1:]))
            out.append({"costs": [costs[g][s] for s in range(4) for g in range(4)], "illegal": illegal, "first": codes[0] % 4, "last": codes[-1] % 4})
        yield pa.array(out, pa.struct([("costs", pa.list_(pa.int64())), ("illegal", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))


#: Neighbours that may stand together: su, ua, au.
LEGAL = ((0, 1), (1, 2), (2, 1))


@F.arrow_udf(StructType().add("after", ArrayType(ArrayType(LongType()))).add("cost", LongType()).add("illegal", LongType()))
def _folded(chains: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The pieces of a conversation, backwards: the costs after each, and the whole."""
    for batch in chains:
        out = []
        for chain in batch.to_pylist():
            after, vector = [], END
            for link in reversed(chain):
                after.append(list(vector))
                costs = link["costs"]
                vector = tuple(min(min(costs[4 * s + g] + vector[g] for g in range(4)), FAR) for s in range(4))
            illegal = sum(x["illegal"] for x in chain) + sum((x["last"], y["first"]) not in LEGAL for x, y in zip(chain, chain[1:]))
            out.append({"after": after[::-1], "cost": vector[START], "illegal": illegal})
        yield pa.array(out, pa.struct([("after", pa.list_(pa.list_(pa.int64()))), ("cost", pa.int64()), ("illegal", pa.int64())]))


_EDITS = ArrayType(StructType().add("letter", StringType()).add("at", IntegerType()).add("role", StringType()))
_EDIT_TYPE = pa.list_(pa.struct([("letter", pa.string()), ("at", pa.int32()), ("role", pa.string())]))


@F.arrow_udf(ArrayType(IntegerType()))
def _exits(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for codes, after, last in parts:
        found = [[s for s, _ in walk(_decoded(c), tuple(v), [0, 1, 2, 3], end)] for c, v, end in zip(codes.to_pylist(), after.to_pylist(), last.to_pylist())]
        yield pa.array(found, pa.list_(pa.int32()))


@F.arrow_udf(_EDITS)
def _edits(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for codes, after, last, entry in parts:
        found = [[e._asdict() for e in walk(_decoded(c), tuple(v), [s], end)[0][1]] for c, v, end, s in zip(codes.to_pylist(), after.to_pylist(), last.to_pylist(), entry.to_pylist())]
        yield pa.array(found, _EDIT_TYPE)


def ordered(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` (conv_id, turn, role, text) with ``pos``, their places by conversation, turn (null first), role and text.

    Rows are dealt by ranges of all of these, so that a conversation of any length lies over as many tasks as it needs.
    Null roles and texts are empty here; other columns are left out.
    """
    keys = ["conv_id", "turn", "role", "text"]
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id())
    return stored(rows.select(F.struct("conv_id").alias("conv"), "pos", "turn", "role", "text"), "turns")


def _pieces(rows: DataFrame, bits: int) -> DataFrame:
    """(conv, piece, start, codes, blank, duplicate, truncated): rows as one letter each, at most 2^bits of them a piece."""
    seen = F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    initial = F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1)
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    narrow = rows.select("conv", "pos", same.alias("same"), initial.alias("initial"), (seen == "").alias("blank"), (~seen.rlike(r"[.!?]$")).alias("cut"))
    # only what comes again is joined: few rows, whatever the number of times
    first = narrow.where(~F.col("blank")).groupBy("conv", "same").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    fault = F.when(F.col("blank"), BLANK).when(F.col("pos") > F.col("first"), DUPLICATE).when(F.col("cut"), CUT_OFF).otherwise(SOUND)
    coded = narrow.join(first, ["conv", "same"], "left").select("conv", "pos", fault.alias("fault"), (F.col("initial") + 4 * fault).alias("code"))
    letter = F.substring(F.lit("abcdefghijklmnop"), F.col("code") + 1, F.lit(1))
    counts = [F.count_if(F.col("fault") == n).alias(name) for n, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT_OFF, "truncated"))]
    found = coded.groupBy("conv", F.shiftright("pos", bits).alias("piece")).agg(F.min("pos").alias("start"), F.array_sort(F.collect_list(F.struct("pos", letter.alias("c")))).alias("rows"), *counts)
    return found.withColumn("codes", F.array_join(F.transform("rows", lambda r: r["c"]), "")).drop("rows")


def repairs(rows: DataFrame, bits: int = PIECE_BITS) -> tuple[DataFrame, DataFrame]:
    """From :func:`ordered` rows: (conv, blank, duplicate, truncated, illegal, cost) and the edits (conv, piece, start, edits).

    Every conversation is cut into pieces of at most 2^bits rows; a piece becomes a matrix of costs between states, the matrices of a conversation
    (one row for 65,536 turns) are folded backwards into the cost vectors at the ends of its pieces, and each piece is then
    walked on its own from those. ``edits`` lists letter, at (row of the piece, an insertion: the row it precedes) and role.
    Faults: blank texts, repetitions of role and text, texts whose last visible character ends no sentence; the first counts.
    """
    pieces = stored(_pieces(rows, bits), "pieces")
    chains = pieces.select("conv", "piece", "blank", "duplicate", "truncated", _through("codes").alias("t"))
    link = F.struct("piece", "t.costs", "t.illegal", "t.first", "t.last")
    chains = chains.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.array_sort(F.collect_list(link)).alias("links"))
    chains = stored(chains.withColumn("f", _folded("links")).select("conv", "blank", "duplicate", "truncated", F.transform("links", lambda x: x["piece"]).alias("pieces"), "f"), "chains")
    summary = chains.select("conv", "blank", "duplicate", "truncated", "f.illegal", "f.cost")
    ends = chains.select("conv", F.size("pieces").alias("n"), F.posexplode(F.arrays_zip("pieces", "f.after")).alias("k", "x"))
    ends = ends.select("conv", F.col("x.pieces").alias("piece"), F.col("x.after").alias("after"), (F.col("k") + 1 == F.col("n")).alias("last"), "n")
    placed = stored(pieces.select("conv", "piece", "start", "codes").join(ends, ["conv", "piece"]), "placed")
    several = placed.where("n > 1").select("conv", F.struct("piece", _exits("codes", "after", "last").alias("exits")).alias("e"))
    several = several.groupBy("conv").agg(F.array_sort(F.collect_list("e")).alias("chain"))
    enter = F.aggregate("chain", F.struct(F.lit(START).alias("now"), F.array().cast("array<int>").alias("at")), lambda s, e: F.struct(F.element_at(e["exits"], s["now"] + 1).alias("now"), F.concat(s["at"], F.array(s["now"])).alias("at")), lambda s: s["at"])
    enter = several.select("conv", F.explode(F.arrays_zip(F.transform("chain", lambda e: e["piece"]).alias("piece"), enter.alias("entry"))).alias("x")).select("conv", "x.piece", "x.entry")
    edits = placed.join(enter, ["conv", "piece"], "left").withColumn("entry", F.coalesce("entry", F.lit(START)))
    return summary, edits.select("conv", "piece", "start", _edits("codes", "after", "last", "entry").alias("edits"))


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The turns after the edits: conv, piece, place (its order in the piece), role, text."""
    each = edits.select("conv", "piece", "start", F.posexplode("edits").alias("place", "e")).where("e.letter <> 'D'")
    each = each.select("conv", "piece", "place", F.col("e.role").alias("given"), F.when(F.col("e.letter") != "I", F.col("start") + F.col("e.at")).alias("pos"))
    inserted = each.where("pos is null").select("conv", "piece", "place", F.col("given").alias("role"), F.lit("").alias("text"))
    taken = each.where("pos is not null").join(rows.select("pos", "role", "text"), "pos").select("conv", "piece", "place", F.coalesce("given", "role").alias("role"), "text")
    return taken.unionByName(inserted)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each run of rows of one conversation; only the running digest is held."""
    open_key, digest = (), None
    for batch in batches:
        keys, digests = [], []
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if (conv,) != open_key:
                if digest is not None:
                    keys.append(open_key[0])
                    digests.append(digest.hexdigest())
                open_key, digest = (conv,), hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_key[0]], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])


def repaired_digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of ``role:text`` lines in order. A digest runs through its text from first to last, so one task reads all of a conversation's lines, streaming."""
    lines = turns.select("conv.conv_id", "piece", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = small_batches(lines).repartition("conv_id").sortWithinPartitions("conv_id", "piece", "place")
    return lines.select("conv_id", "line").mapInArrow(_digests, "conv_id long, repaired_sha256 string").select(F.struct("conv_id").alias("conv"), "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with planted faults, by crc32 of ``conv_id:turn``; nulls are one space, in that key too."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("time")).drop("time")


def _whole(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)).cast("long")


def audited(turns: DataFrame, conversations: DataFrame, bits: int = PIECE_BITS) -> DataFrame:
    """One row for each conv_id of ``conversations``: gaps, counts of faults, cost and letters of the cheapest repair of ``turns``, and the digest of the repaired text.

    Gaps are counted over the turns that are not null. A null conv_id is one conversation. Rows of one turn follow one
    another by role and text, equal rows are told apart by nothing and the second is a duplicate. A conversation without
    rows in ``turns`` has zeros, no letters and the digest of the empty text; an empty table gives no rows. Other columns are
    ignored; texts of any length count whole.
    """
    rows = ordered(turns)
    summary, edits = repairs(rows, bits)
    edits = stored(edits, "edits")
    gaps = rows.groupBy("conv", "turn").count().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    letters = edits.select("conv", F.struct("piece", F.array_join(F.transform("edits", lambda e: e["letter"]), "").alias("letters")).alias("a"))
    letters = letters.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["letters"]), "").alias("audit"))
    digests = repaired_digests(repaired_turns(rows, edits))
    found = conversations.select(F.struct(F.col("conv_id").cast("long").alias("conv_id")).alias("conv")).distinct()
    for part in (gaps, summary, letters, digests):
        found = found.join(part, "conv", "left")
    counts = [_whole(F.col(c)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return found.select("conv.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return audited(damaged(conversations), conversations)


#: The same by carrying, row by row from the last, each state's cheapest cost with its letters and repaired lines.
OP11_SQL = r"""
WITH RECURSIVE bits(b, c, n) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM bits WHERE n < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE n = 8),
named AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind
  FROM named, crc
), broken AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS time
  FROM dealt WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, time) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, time) AS again,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, time) AS before
  FROM broken
), faults AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS r FROM numbered
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
), back(conv_id, i, q0, q1, q2, q3) AS (
  SELECT conv_id, n + 1, {'c': 0::BIGINT, 'a': '', 't': ''}, {'c': 4::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'},
    {'c': 2::BIGINT, 'a': 'I', 't': chr(10) || 'assistant:'}, {'c': 0::BIGINT, 'a': '', 't': ''} FROM counted
  UNION ALL
  SELECT conv_id, i, least(w0, {'c': u.c + 2, 'a': 'I' || u.a, 't': chr(10) || 'user:' || u.t}), least(w1, {'c': u.c + 2, 'a': 'I' || u.a, 't': chr(10) || 'user:' || u.t}), u, s FROM (
    SELECT *, least(w2, {'c': w3.c + 2, 'a': 'I' || w3.a, 't': chr(10) || 'assistant:' || w3.t}) AS u, least(w3, {'c': w2.c + 2, 'a': 'I' || w2.a, 't': chr(10) || 'user:' || w2.t}) AS s FROM (
      SELECT b.conv_id, f.i,
        least({'c': q0.c + 3, 'a': 'D' || q0.a, 't': q0.t}, {'c': CASE WHEN gone OR r <> 's' THEN 1000000 ELSE worn END + q1.c, 'a': 'K' || q1.a, 't': line || q1.t}, {'c': CASE WHEN gone OR r <> 'u' THEN 1000000 ELSE worn END + q2.c, 'a': 'K' || q2.a, 't': line || q2.t}, {'c': CASE WHEN gone THEN 1000000 ELSE worn + 2 END + q2.c, 'a': 'R' || q2.a, 't': as_user || q2.t}) AS w0,
        least({'c': q1.c + 3, 'a': 'D' || q1.a, 't': q1.t}, {'c': CASE WHEN gone OR r <> 'u' THEN 1000000 ELSE worn END + q2.c, 'a': 'K' || q2.a, 't': line || q2.t}, {'c': CASE WHEN gone THEN 1000000 ELSE worn + 2 END + q2.c, 'a': 'R' || q2.a, 't': as_user || q2.t}) AS w1,
        least({'c': q2.c + 3, 'a': 'D' || q2.a, 't': q2.t}, {'c': CASE WHEN gone OR r <> 'a' THEN 1000000 ELSE worn END + q3.c, 'a': 'K' || q3.a, 't': line || q3.t}, {'c': CASE WHEN gone THEN 1000000 ELSE worn + 2 END + q3.c, 'a': 'R' || q3.a, 't': as_assistant || q3.t}) AS w2,
        least({'c': q3.c + 3, 'a': 'D' || q3.a, 't': q3.t}, {'c': CASE WHEN gone OR r <> 'u' THEN 1000000 ELSE worn END + q2.c, 'a': 'K' || q2.a, 't': line || q2.t}, {'c': CASE WHEN gone THEN 1000000 ELSE worn + 2 END + q2.c, 'a': 'R' || q2.a, 't': as_user || q2.t}) AS w3
      FROM back b JOIN (
        SELECT conv_id, i, r, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS worn,
          chr(10) || role || ':' || text AS line, chr(10) || 'user:' || text AS as_user, chr(10) || 'assistant:' || text AS as_assistant FROM faults
      ) f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1
    )
  )
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(q0.c, 0) AS cost, coalesce(q0.a, '') AS audit, sha256(coalesce(substr(q0.t, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN counted ON ids.conv_id IS NOT DISTINCT FROM counted.conv_id LEFT JOIN back ON ids.conv_id IS NOT DISTINCT FROM back.conv_id AND back.i = 1
"""
