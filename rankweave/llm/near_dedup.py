"""Near-duplicate documents: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from rankweave.llm.common import release, small_batches
from rankweave.llm.components import components
from rankweave.session import drop_stored, stored
from rankweave.sources.tables import spread, table

#: Words in a shingle; shingles kept in a sketch; percent of the union that linked documents share.
WORDS, KEPT, PERCENT = 5, 64, 75
#: Fewest values that the sketches of two linked documents share when sketches are not whole sets. The shared part of the
#: union's 64 smallest values has mean 48 or more; fewer than 28 has a chance of about 1e-8.
SHARED = 28
#: Bytes of the sets of a list that are compared at once.
BLOCK = 16 << 20
#: Most ids that are broadcast (about 100 MB).
SENT = 1_000_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


class _WordHashes(dict):
    """64-bit hashes of words; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    hashed = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    made = np.full(n, k, np.uint64)
    for i in range(k):
        made = made * _FACTOR + hashed[i : i + n]
    made = (made ^ (made >> np.uint64(33))) * _MIX
    return np.unique((made ^ (made >> np.uint64(33))).view(np.int64))


def _set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, kept = [], [], []
        for text in batch.column(1):
            values = shingles(text.as_py())
            sizes.append(len(values))
            keys.append(_set_key(values) if len(values) else None)
            kept.append(values[:KEPT])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
        flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            names=["doc_id", "n_shingles", "set_key", "sketch"],
        )
    _HASHES.clear()
    release()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set) and the KEPT smallest shingle hashes, from whole texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketches, "doc_id long, n_shingles long, set_key binary, sketch array<long>")


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for doc_id, text, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            values = shingles(text.as_py())
            if len(values) and _set_key(values) == key:
                found.append((doc_id, values.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["id", "members"])
    _HASHES.clear()
    release()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets share PERCENT of their union; sets whose sketches make that unlikely are not merged.

    The union-sketch estimate is the shared values over all values up to the nearer sketch's end. It may lie 5.6 deviations
    under the threshold.
    """
    n, m = len(a), len(b)
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    top = np.iinfo(np.int64).max
    end = min(a[KEPT - 1] if n > KEPT else top, b[KEPT - 1] if m > KEPT else top)
    p, q = a[:KEPT], b[:KEPT]
    p, q = p[: np.searchsorted(p, end, "right")], q[: np.searchsorted(q, end, "right")]
    shared = int(np.isin(p, q, assume_unique=True).sum())
    known = len(p) + len(q) - shared
    if shared < PERCENT / 100 * known - 5.6 * np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) * known):
        return False
    at = np.minimum(np.searchsorted(b, a), m - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= PERCENT * (n + m - both)


def group_links(ids: list[int], sides: list[int], sets: list[np.ndarray], across: bool, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join the members of one list as exact Jaccard does: a spanning part of them, no pair left unexamined.

    Members already joined (of one label, if ``labels`` are given) are not compared again. Of the rest, those whose
    union-sketch estimate (as in :func:`similar`) allows it are verified on full sets. ``across``: only pairs of different
    sides.
    """
    m = len(ids)
    size = np.array([len(x) for x in sets])
    flat, index = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)])
    top = np.iinfo(np.int64).max
    in_sketch = np.minimum(size, KEPT)
    place = np.full((m, KEPT), len(flat), np.int64)
    value = np.full((m, KEPT), top, np.int64)
    for r in range(m):
        place[r, : in_sketch[r]] = index[starts[r] : starts[r] + in_sketch[r]]
        value[r, : in_sketch[r]] = sets[r][:KEPT]
    ends = np.where(size > KEPT, value[:, -1], top)
    side = np.array(sides)
    label = np.arange(m) if labels is None else np.unique(labels, return_inverse=True)[1]
    mark = np.zeros(len(flat) + 1, bool)
    links = []
    for z in range(m - 1):
        ok = (label != label[z]) & (100 * np.minimum(size, size[z]) >= PERCENT * np.maximum(size, size[z]))
        ok[: z + 1] = False
        if across:
            ok &= side != side[z]
        others = np.flatnonzero(ok)
        if not len(others):
            continue
        own = place[z, : in_sketch[z]]
        mark[own] = True
        shared = mark[place[others]].sum(axis=1)
        mark[own] = False
        end = np.minimum(ends[z], ends[others])
        known = np.searchsorted(value[z, : in_sketch[z]], end, "right") + np.minimum((value[others] <= end[:, None]).sum(axis=1), in_sketch[others]) - shared
        others = others[shared >= PERCENT / 100 * known - 5.6 * np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) * known)]
        if not len(others):
            continue
        own = index[starts[z] : starts[z + 1]]
        mark[own] = True
        hits = mark[np.concatenate([index[starts[o] : starts[o + 1]] for o in others])]
        mark[own] = False
        both = np.add.reduceat(hits.astype(np.int64), np.concatenate([[0], np.cumsum(size[others])[:-1]]))
        linked = others[100 * both >= PERCENT * (size[z] + size[others] - both)]
        for o in linked:
            if label[o] != label[z]:
                label[label == label[o]] = label[z]
                links.append((ids[z], ids[o]))
    return links


def _pair_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [similar(np.frombuffer(p.as_buffer(), np.int64), np.frombuffer(q.as_buffer(), np.int64)) for p, q in zip(batch.column(2), batch.column(3), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _list_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            for k, row in enumerate(zip(*columns, strict=True)):
                yield *row, np.frombuffer(batch.column(6)[k].as_buffer().to_pybytes(), np.int64)

    for (_, i, j), members in groupby(rows(), key=lambda r: r[:3]):
        members = list(members)
        if len(members) > 1:
            label_of = {r[4]: r[5] for r in members}
            found = group_links([r[4] for r in members], [r[3] for r in members], [r[6] for r in members], i != j, [r[5] for r in members])
            if found:
                a, b = zip(*((label_of[x], label_of[y]) for x, y in found))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def candidate_lists(reps: DataFrame) -> DataFrame:
    """``reps`` (id, n, sketch) -> inverted lists (v, id, n) in which every pair to be compared meets.

    A document enters the lists of its rarest retained values only: two linked ones share at least ``least`` retained
    values, so one of them is among the first kept - least + 1 of each (rarest first, then by value). Values nobody else has
    take places but make no list, and of lists with the same members one stays.
    """
    postings = reps.select("id", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("v"))
    common = postings.groupBy("v").count().where("count > 1")
    shared = postings.join(common, "v")
    least = F.when(F.col("n") <= KEPT * PERCENT // 100, F.ceil(F.col("n") * PERCENT / 100)).otherwise(SHARED)
    of_doc = Window.partitionBy("id")
    alone = F.col("kept") - F.count("*").over(of_doc)
    rank = F.row_number().over(of_doc.orderBy("count", "v")) + alone
    chosen = stored(shared.select("id", "n", "v", (rank <= F.col("kept") - least + 1).alias("keep")).where("keep").select("v", "id", "n"), "lists")
    alike = chosen.groupBy("v").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("m > 1")
    lists = alike.groupBy("m", "x", "y").agg(F.min("v").alias("v")).select("v")
    return chosen.join(lists, "v")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text; others are ignored).

    Words are runs of other than ASCII white space with A-Z lower-cased; a set holds the distinct five-word shingles, the
    whole sequence where there are fewer words, nothing without words. Documents are linked when they share at least 75 %
    of their union; ``component_id`` is the smallest doc_id reachable. Equal sets are one class, so copies never make
    pairs. Null or empty texts have n_shingles 0 and are linked with nothing. Rows that share a doc_id are one document,
    linked by any of their texts. A row without doc_id has the component of its copies, if any, and is kept. An empty table gives no rows.
    """
    docs = small_batches(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    own = stored(sketches(docs), "sketches")
    usable = own.where("set_key is not null and doc_id is not null")
    classes = stored(usable.groupBy("set_key").agg(F.min("doc_id").alias("id")), "classes")
    reps = usable.join(classes, (usable.doc_id == classes.id) & (usable.set_key == classes.set_key)).select("id", classes.set_key, F.col("n_shingles").alias("n"), "sketch")
    lists = stored(candidate_lists(reps), "lists")
    active = stored(lists.select("id").distinct().join(classes, "id"), "active")
    # a few in a hundred of all documents: sent to the texts while they are few, else the texts are dealt by doc_id
    wanted = F.broadcast(active) if active.count() <= SENT else active
    sets = docs.join(wanted, docs.doc_id == F.col("id")).select("id", "text", "set_key").mapInArrow(_sets, "id long, members binary")
    # of each list all members meet the first: near copies, however many, are mostly joined by that
    first = lists.groupBy("v").agg(F.min("id").alias("a"))
    pairs = lists.join(first, "v").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("p")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("q")), "b")
    links = stored(both.select("a", "b", "p", "q").mapInArrow(_pair_links, "a long, b long"), "links")
    labels = components(links)
    # then lists with members that are not joined yet are compared whole, in blocks of bounded bytes
    labelled = stored(lists.join(labels, "id", "left").select("v", "id", "n", F.coalesce("label", "id").alias("label")), "labelled")
    mixed = labelled.groupBy("v").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum("n").alias("size")).where("low < high")
    blocks = F.ceil(F.col("size") * 8 / BLOCK).cast("int")
    placed = labelled.join(mixed.select("v", "size"), "v").withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "label")
    met = placed.join(sets, "id").repartition("v", "i", "j").sortWithinPartitions("v", "i", "j", "id")
    more = stored(met.select("v", "i", "j", "side", "id", "label", "members").mapInArrow(_list_links, "a long, b long"), "links")
    above = components(more).select(F.col("id").alias("label"), F.col("label").alias("least"))
    with_class = own.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    named = with_class.join(labels, "id", "left").select("doc_id", "n_shingles", F.coalesce("label", "id", "doc_id").alias("label"))
    found = named.join(above, "label", "left").select("doc_id", "n_shingles", F.coalesce("least", "label").alias("component_id"))
    found = found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    result = stored(found, "components")
    drop_stored(own, classes, lists, active, links, labelled, more)
    return result


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without all but one, that with the smallest doc_id, of each group of near duplicates.

    Of rows that share a doc_id one stays, that with the least text (null first), then with the least whole row as JSON, so
    reruns agree; further columns may have any name and type. Rows without doc_id all stay, documents without words too. An empty table stays empty.
    """
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    alone = named.join(several, "doc_id", "left_anti")
    chosen = named.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row")).select("row.*")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return alone.select(columns).unionByName(chosen.select(columns)).unionByName(docs.where("doc_id is null"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same by comparing all sets that share a shingle.
OP5_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(generate_series(1, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM split
), each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(c, doc_id)) AS kept FROM sets LEFT JOIN least USING (doc_id)
"""
