"""Tries of conversation prefixes: double arrays over shards of prefixes, with the nodes above the shards merged globally."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from rankweave.llm.common import words
from rankweave.llm.structure_repair import ordered
from rankweave.session import stored
from rankweave.sources.tables import spread, table

#: Rows of different conversations that a prefix may have below it in one shard; longer ones are split at their children.
SHARD_ROWS = 1 << 14
#: Turns of one conversation whose prefix keys are summed up in one window.
STRETCH_BITS = 14
#: Free cells tried for a node with several children before its children go behind the last used cell.
TRIES = 32
EMPTY = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """A trie as two arrays: the child of node s by symbol c is the cell BASE[s] + c, where CHECK says s."""

    def __init__(self, cells: int = 1024):
        self.base = np.zeros(cells, np.int64)
        self.check = np.full(cells, -1, np.int64)
        self.check[0] = 0  # the root's own cell
        self.free, self.last = 1, 0  # no cell before ``free`` is free, none after ``last`` is used

    def _room(self, cell: int) -> None:
        while cell >= len(self.check):
            self.base = np.concatenate([self.base, np.zeros_like(self.base)])
            self.check = np.concatenate([self.check, np.full_like(self.check, -1)])

    def add(self, node: int, symbols: np.ndarray) -> None:
        """Place all children of ``node``, by rising symbols."""
        while self.free <= self.last and self.check[self.free] >= 0:
            self.free += 1
        spread_, cell = int(symbols[-1] - symbols[0]), self.free
        self._room(max(cell, self.last + 1) + spread_)
        if len(symbols) > 1:
            steps, tried = symbols - symbols[0], 0
            while cell <= self.last and (self.check[cell] >= 0 or (self.check[cell + steps] >= 0).any()):
                cell, tried = (cell + 1, tried + 1) if tried < TRIES else (self.last + 1, tried)
        self.base[node] = cell - int(symbols[0])
        cells = self.base[node] + symbols
        self.check[cells] = node
        self.last = max(self.last, int(cells[-1]))

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of ``nodes`` by ``symbols``; -1 where there is none."""
        cells = self.base[nodes] + symbols
        inside = (cells >= 0) & (cells < len(self.check))
        return np.where(inside & (self.check[np.where(inside, cells, 0)] == nodes) & (cells > 0), cells, -1)


def trie_nodes(first: np.ndarray, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[DoubleArray, list[tuple[np.ndarray, np.ndarray]]]:
    """A double array of sequences, and level by level which sequences are still there and the cells they stand in.

    Sequence k is the symbol ``first[k]`` and ``symbols[starts[k]:starts[k] + lengths[k]]``; symbols count from 1.
    """
    trie, levels = DoubleArray(), []
    alive, at = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    depth = 0
    while len(alive):
        symbol = first[alive] if depth == 0 else symbols[starts[alive] + depth - 1]
        width = int(symbol.max()) + 1
        pairs = np.unique(at * width + symbol)
        nodes, children = pairs // width, pairs % width
        cuts = np.flatnonzero(np.diff(nodes)) + 1
        for node, own in zip(nodes[np.concatenate([[0], cuts])], np.split(children, cuts)):
            trie.add(int(node), own)
        at = trie.step(at, symbol)
        levels.append((alive, at))
        depth += 1
        left = lengths[alive] >= depth
        alive, at = alive[left], at[left]
    return trie, levels


_SHARD = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean, p1 long, p2 long, ends long"
_SHARD_TYPE = pa.schema([(n, pa.bool_() if n == "top" else pa.int64()) for n in (c.split()[0] for c in _SHARD.split(", "))])


def _shard(rows: pa.Table) -> pa.Table:
    """The nodes of one bucket of shards, from rows (conv, depth, shard key s1 s2, parent key p1 p2, digest, words, n)."""
    rows = rows.combine_chunks().sort_by([("conv", "ascending"), ("depth", "ascending")])
    conv, depth, n, n_words = (rows[c].to_numpy() for c in ("conv", "depth", "n", "words"))
    symbols = rows["digest"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) + 1  # dense ids by first appearance
    shards = pc.binary_join_element_wise(pc.cast(rows["s1"], pa.string()), pc.cast(rows["s2"], pa.string()), " ").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
    lengths = np.diff(np.concatenate([starts, [len(conv)]]))
    trie, levels = trie_nodes(shards[starts], symbols, starts, lengths)
    size = len(trie.check)
    members, children, leaves, saved = (np.zeros(size, np.int64) for _ in range(4))
    least, ends, row_of = np.full(size, np.iinfo(np.int64).max), np.full(size, -1, np.int64), np.zeros(size, np.int64)
    cells = []
    for level, (alive, at) in enumerate(levels):
        np.add.at(members, at, n[starts[alive]])
        np.minimum.at(least, at, conv[starts[alive]])
        if level:
            row_of[at] = starts[alive] + level - 1
            over = lengths[alive] == level
            ends[at[over]] = starts[alive[over]]
        cells.append(np.unique(at))
    for level in range(len(cells) - 1, 0, -1):
        own = cells[level]
        leaves[own] = np.where(children[own] == 0, 1, leaves[own])
        saved[own] += (members[own] - 1) * n_words[row_of[own]]
        above = trie.check[own]
        np.add.at(children, above, 1)
        np.add.at(leaves, above, leaves[own])
        np.add.at(saved, above, saved[own])
    found = np.concatenate(cells[1:]) if len(cells) > 1 else np.empty(0, np.int64)
    top = np.isin(found, cells[1]) if len(cells) > 1 else np.empty(0, bool)
    at = row_of[found]
    masked = lambda values, absent: pa.array(values, pa.int64(), mask=absent)
    columns = [
        pa.array(least[found]),
        pa.array(depth[at]),
        masked(least[trie.check[found]], top),
        pa.array(members[found]),
        pa.array(children[found]),
        pa.array(leaves[found]),
        pa.array(saved[found]),
        pa.array(top),
        masked(rows["p1"].to_numpy()[at], ~top),
        masked(rows["p2"].to_numpy()[at], ~top),
        masked(conv[np.maximum(ends[found], 0)], ends[found] < 0),
    ]
    return pa.Table.from_arrays(columns, schema=_SHARD_TYPE)


def _step(n: int):
    """What the last turn adds to a prefix key: keys are exclusive-ors of these over the turns, so a parent's key is its child's without it."""
    return F.xxhash64(F.lit(n), "depth", "digest") if n == 1 else F.xxhash64("digest", "depth", F.lit(n))


def keyed(turns: DataFrame, bits: int = STRETCH_BITS) -> DataFrame:
    """``turns`` (conv, depth, digest, ...) with the 128-bit key k1, k2 of the prefix that ends with each turn.

    Windows reach over stretches of 2^bits turns; a stretch starts from the key of the stretches before it.
    """
    stretch = F.shiftright("depth", bits)
    turns = turns.withColumn("stretch", stretch)
    whole = turns.groupBy("conv", "stretch").agg(F.bit_xor(_step(1)).alias("x1"), F.bit_xor(_step(2)).alias("x2"))
    earlier = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("conv", "stretch", F.bit_xor("x1").over(earlier).alias("b1"), F.bit_xor("x2").over(earlier).alias("b2")).where("stretch > 0 and b1 is not null")
    own = Window.partitionBy("conv", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    found = turns.join(before, ["conv", "stretch"], "left")
    keys = {f"k{n}": F.bit_xor(_step(n)).over(own).bitwiseXOR(F.coalesce(f"b{n}", F.lit(0).cast("long"))) for n in (1, 2)}
    return found.withColumns(keys).drop("stretch", "b1", "b2")


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined numbers of each run of rows with one key; only the running digest is held."""
    open_key, digest = None, None
    names = ["rep", "ends_sha256"]
    for batch in batches:
        keys, digests = [], []
        for key, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != open_key:
                if digest is not None:
                    keys.append(open_key)
                    digests.append(digest.hexdigest())
                open_key, digest = key, hashlib.sha256(str(number).encode())
            else:
                digest.update(b",%d" % number)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(digests, pa.string())], names=names)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_key], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=names)


def end_digests(members: DataFrame) -> DataFrame:
    """(rep, ends_sha256) of the numbers (rep, conv) of each rep; a digest runs from first to last, so a group's numbers stream through one task."""
    dealt = members.repartition("rep").sortWithinPartitions("rep", "conv")
    return dealt.select("rep", "conv").mapInArrow(_joined, "rep long, ends_sha256 string")


def prefix_nodes(turns: DataFrame, conversations: DataFrame, shard_rows: int = SHARD_ROWS, bits: int = STRETCH_BITS) -> DataFrame:
    """The trie of ``turns`` (conv, depth from 1 without gaps, length of the conversation, digest, words) and of ``conversations`` (conv, length).

    One row for each prefix: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Conversations that are equal throughout are counted first and enter the trie once. A prefix with more than
    ``shard_rows`` turns below it is an upper node, kept in tables; the subtrees right below upper nodes are the shards, each
    packed into a double array in one task. Upper nodes get the sums of what hangs below them by suffix sums along the paths of
    the smallest members. Without conversations there is no row; turnless ones are members of the root alone.
    """
    paths = stored(keyed(turns, bits), "paths")
    classes = stored(paths.where("depth = length").groupBy("k1", "k2", "depth").agg(F.min("conv").alias("rep"), F.count("*").alias("n")), "classes")
    single = paths.join(classes.select(F.col("rep").alias("conv"), "n"), "conv")
    single = single.withColumns({f"p{n}": F.col(f"k{n}").bitwiseXOR(_step(n)) for n in (1, 2)})
    single = stored(single.select("conv", "depth", "length", "digest", "words", "k1", "k2", "p1", "p2", "n"), "single")
    weight = F.sum(F.col("length") - F.col("depth") + 1)
    upper = single.groupBy("k1", "k2", "depth").agg(weight.alias("weight"), F.min("conv").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    upper = upper.where(F.col("weight") > shard_rows).drop("weight")
    whole = conversations.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = whole.select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("words"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    upper = stored(upper.select("k1", "k2", "depth", "conv_id", "n_convs", "words", "p1", "p2").unionByName(root), "upper")
    key = ["k1", "k2", "depth"]
    flagged = single.join(upper.select(*key, F.lit(True).alias("up")), key, "left")
    below = flagged.where("up is null")
    shard = below.groupBy("conv").agg(F.min(F.struct("depth", "k1", "k2")).alias("s")).select("conv", F.col("s.k1").alias("s1"), F.col("s.k2").alias("s2"))
    buckets = max(1, -(-single.count() // shard_rows))
    dealt = below.join(shard, "conv").select(F.pmod(F.xxhash64("s1", "s2"), F.lit(buckets)).alias("bucket"), "conv", "depth", "s1", "s2", "p1", "p2", "digest", "words", "n")
    nodes = stored(dealt.groupBy("bucket").applyInArrow(_shard, _SHARD), "nodes")
    # upper nodes: children and, along the path of each smallest member, what hangs at and below each place
    tops = nodes.where("top").select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_leaves", "saved_tokens")
    deeper = upper.where("depth > 0")
    children = tops.select(*key).unionByName(deeper.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth"))).groupBy(*key).agg(F.count("*").alias("n_children"))
    own = upper.select("conv_id", "depth", zero.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    hung = tops.select(*own.columns).unionByName(own).groupBy(F.col("conv_id").alias("conv"), "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    places = flagged.where("up").select("conv", *key).unionByName(hung.select("conv").distinct().select("conv", zero.alias("k1"), zero.alias("k2"), zero.alias("depth")))
    suffix = Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = places.join(hung, ["conv", "depth"], "left").select(*key, *[F.sum(F.coalesce(c, zero)).over(suffix).alias(c) for c in ("n_leaves", "saved_tokens")])
    sums = sums.groupBy(*key).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    over = classes.select(*key, F.col("rep").alias("ends"))
    high = upper.join(children, key, "left").join(sums, key, "left").join(over, key, "left")
    high = high.withColumns({"n_children": F.coalesce("n_children", zero), "n_leaves": F.when(F.coalesce("n_children", zero) == 0, 1).otherwise(F.coalesce("n_leaves", zero)), "saved_tokens": F.coalesce("saved_tokens", zero)})
    # parents of what hangs on upper nodes; the root is one number
    first = whole.first()
    named = upper.where("depth > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "p1", "p2", "ends"]
    hanging = nodes.where("top").select(*columns).unionByName(high.select(*columns)).join(named, ["p1", "p2", "depth"], "left")
    parent = F.when(F.col("depth") == 1, F.lit(first["conv_id"] if first else None)).otherwise(F.col("above")).cast("long")
    hanging = hanging.withColumn("parent_conv_id", parent)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    every = hanging.select(*columns).unionByName(nodes.where("not top").select(*columns))
    # who ends where: groups of equal conversations, and the turnless at the root
    several = paths.where("depth = length").join(classes.where("n > 1").select(*key, "rep"), key).select("rep", "conv")
    turnless = conversations.where("length = 0").select("conv")
    digests = end_digests(several)
    at_root = end_digests(turnless.select(zero.alias("rep"), "conv")).select(zero.alias("depth"), F.col("ends_sha256").alias("none_left"))
    found = every.join(digests, F.col("ends") == F.col("rep"), "left").join(at_root, "depth", "left")
    alone = F.when(F.col("ends").isNotNull(), F.sha2(F.col("ends").cast("string"), 256)).otherwise(EMPTY)
    return found.select(*columns[:-1], F.coalesce("ends_sha256", "none_left", alone).alias("ends_sha256"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, length, digest, words) and (conv, length) of all conversations, each led by turns of its block's first one.

    Conversation c begins with the first h turns of conversation c - c % 20, h the crc32 of c modulo 4 (all if there are
    fewer, none if it is absent), followed by its own turns after its first h. Turns stand by turn (null first), role and
    text; null roles and texts are empty. Rows without conv_id belong to no conversation and are left out.
    """
    rows = ordered(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"))
    # a row's place in its conversation: after those of earlier parts of the table, and of its own part
    part = F.shiftright("pos", 33).alias("part")
    counted = rows.groupBy("conv", part).agg(F.min("pos").alias("start"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = stored(counted.withColumn("skipped", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "parts")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    turns = rows.select("conv", part, "pos", F.substring(digest, 1, 32).alias("digest"), F.size(words(F.col("text"))).cast("long").alias("words"))
    turns = turns.join(counted, ["conv", "part"]).select(F.col("conv.conv_id").alias("conv"), (F.col("pos") - F.col("start") + F.col("skipped")).alias("i"), "digest", "words")
    turns = stored(turns, "numbered")
    sizes = counted.groupBy(F.col("conv.conv_id").alias("conv")).agg(F.sum("n").alias("n"))
    heads = sizes.where("conv % 20 = 0").select(F.col("conv").alias("lead"), F.least("n", F.lit(3)).alias("lead_n"))
    led = sizes.withColumns({"h": F.crc32(F.col("conv").cast("string")) % 4, "lead": F.col("conv") - F.col("conv") % 20}).join(heads, "lead", "left")
    led = led.withColumn("m", F.least("h", F.coalesce("lead_n", F.lit(0))))
    led = stored(led.select("conv", "lead", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "led")
    own = turns.join(led, "conv").where("i >= h").select("conv", (F.col("i") - F.col("h") + F.col("m") + 1).alias("depth"), "length", "digest", "words")
    lead_turns = turns.where("conv % 20 = 0 and i < 3").select(F.col("conv").alias("lead"), "i", "digest", "words")
    lent = led.where("m > 0").join(lead_turns, "lead").where("i < m").select("conv", (F.col("i") + 1).alias("depth"), "length", "digest", "words")
    return own.unionByName(lent), led.select("conv", "length")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_nodes(*rebuilt(spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


#: The same with whole prefixes as keys; what a subtree sums up is added to every prefix of each node.
OP12_SQL = r"""
WITH RECURSIVE bits(b, c, n) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM bits WHERE n < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE n = 8),
filled AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM filled),
led AS (
  SELECT conv_id, conv_id - conv_id % 20 AS lead, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM filled), crc
), parts AS (
  SELECT led.conv_id, 0 AS part, i, role, text FROM led JOIN numbered ON numbered.conv_id = led.lead WHERE i < h
  UNION ALL SELECT led.conv_id, 1, i, role, text FROM led JOIN numbered ON numbered.conv_id = led.conv_id WHERE i >= h
), turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS depth, count(*) OVER (PARTITION BY conv_id) AS n FROM parts),
paths AS (
  SELECT conv_id, depth, n, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM turns
  UNION ALL SELECT led.conv_id, 0, (SELECT count(*) FROM turns WHERE turns.conv_id = led.conv_id), '', 0 FROM led
), nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS own,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM paths GROUP BY key, depth
), tree AS (
  SELECT nodes.*, parent.key AS parent_key, parent.conv_id AS parent_conv_id FROM nodes
  LEFT JOIN paths ON paths.conv_id = nodes.conv_id AND paths.depth = nodes.depth - 1 LEFT JOIN nodes parent ON parent.key = paths.key AND parent.depth = paths.depth
), children AS (SELECT parent_key AS key, parent_conv_id AS conv_id, count(*) AS n FROM tree WHERE depth > 0 GROUP BY ALL),
sums AS (
  SELECT paths.key, paths.depth, sum(tree.own) AS saved, count(*) FILTER (children.n IS NULL) AS leaves
  FROM tree LEFT JOIN children ON children.key = tree.key AND children.conv_id = tree.conv_id JOIN paths ON paths.conv_id = tree.conv_id AND paths.depth <= tree.depth GROUP BY paths.key, paths.depth
)
SELECT tree.conv_id, tree.depth, parent_conv_id, n_convs, coalesce(n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM tree JOIN sums USING (key, depth) LEFT JOIN children ON children.key = tree.key AND children.conv_id = tree.conv_id
"""
