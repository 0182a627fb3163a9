"""BM25 ranking of a batch of queries over postings kept in shards of documents, pruned by score bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

from rankweave.session import stored

K1, B, NEGATIVE_IDF, TOP_K = 1.5, 0.75, 0.25, 20
#: Scores are sums of doubles that are rounded to six places: a bound must fail by more than this.
MARGIN = 1e-5
#: Terms of questions that go to all tasks at once, and how many shards there are before some are ranked first for thresholds.
ASKED_BLOCK, LEADING = 250_000, 32
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_RUN = regex.compile(r"\p{Han}+|[\p{L}\p{N}--\p{Han}]+", regex.V1)
_HAN = regex.compile(r"\p{Han}{2}")


def cut(low: str, han_bigrams: bool = False) -> list[str]:
    """The terms of a lower-cased text."""
    if not han_bigrams:
        return _WORD.findall(low)
    found = []
    for run in _RUN.findall(low):
        found += [run[k : k + 2] for k in range(len(run) - 1)] if _HAN.match(run) else [run]
    return found


def tokens(text: Column, han_bigrams: bool = False) -> Column:
    """Lower-cased runs of letters and digits, repeats kept; with ``han_bigrams`` a run of Han characters gives its pairs."""

    @F.arrow_udf(ArrayType(StringType()))
    def terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([cut(low.as_py(), han_bigrams) for low in batch], pa.list_(pa.string()))

    return terms(F.lower(F.coalesce(text, F.lit(""))))


@dataclass(frozen=True)
class LexicalIndex:
    """Postings of ``segments`` batches of documents, terms (term, idf), the mean length and the number of shards.

    ``postings`` has a row for each term of a shard, a shard being what one task read at once (at most some thousand documents):
    shard, term, n, nos (the n documents of the shard, rising) and counts. A row without term lists the shard's documents: nos, counts (their
    lengths), places (the corpus order that breaks ties) and ids. A term of any frequency lies over as many rows as there are shards.
    """

    postings: DataFrame
    terms: DataFrame
    mean: float
    shards: int
    han_bigrams: bool = False
    segments: int = 1


def _schema(id_type) -> StructType:
    whole = ArrayType(IntegerType())
    return StructType().add("shard", LongType()).add("term", StringType()).add("n", IntegerType()).add("nos", whole).add("counts", whole).add("places", ArrayType(LongType())).add("ids", ArrayType(id_type))


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, pa.int32()))


def _sharded(segment: int, han_bigrams: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["shard", "term", "n", "nos", "counts", "places", "ids"]

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (segment << 48) + (TaskContext.get().partitionId() << 20)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            terms = [cut(low.as_py(), han_bigrams) for low in batch.column(2)]
            lengths = np.array([len(t) for t in terms])
            named = pa.array(chain.from_iterable(terms), pa.string()).dictionary_encode()
            key = named.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lengths)
            pairs, counts = np.unique(key, return_counts=True)
            sizes = np.bincount(pairs // n, minlength=len(named.dictionary))
            ends = np.cumsum(sizes)
            none = lambda column: pa.nulls(len(sizes), pa.list_(column.type))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), own), pa.int64()), named.dictionary, pa.array(sizes, pa.int32()), _lists(pairs % n, ends), _lists(counts, ends), none(batch.column(1)), none(batch.column(0))], names
            )
            whole = lambda column: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), column)
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.nulls(1, pa.string()), pa.array([n], pa.int32()), _lists(np.arange(n), [n]), _lists(lengths, [n]), whole(batch.column(1)), whole(batch.column(0))], names)
            own += 1

    return shards


def _segment(corpus: DataFrame, han_bigrams: bool, number: int) -> DataFrame:
    low = corpus.select("id", F.col("pos").cast("long").alias("pos"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    return stored(low.mapInArrow(_sharded(number, han_bigrams), _schema(corpus.schema["id"].dataType)), "postings")


def _indexed(postings: DataFrame, han_bigrams: bool, segments: int) -> LexicalIndex:
    """Frequencies over all segments. Inverse frequencies are Okapi's, with a share of their mean where they would be negative."""
    words = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    known = postings.groupBy("term").agg(F.sum("n").alias("df"))
    known = stored(known.where("term is not null"), "frequencies")
    size = postings.where("term is null").agg(F.sum("n").alias("n"), F.sum(words).alias("words"), F.count("*").alias("shards")).head()
    n = size["n"] or 0
    raw = known.select("term", F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    floor = (raw.agg(F.avg("raw")).head()[0] or 0.0) * NEGATIVE_IDF
    terms = raw.select("term", F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.col("raw")).alias("idf"))
    return LexicalIndex(postings, terms, (size["words"] or 0) / n if n else 0.0, size["shards"], han_bigrams, segments)


def build_index(corpus: DataFrame, han_bigrams: bool = False) -> LexicalIndex:
    """``corpus`` has id, pos (a whole number) and text. Every text is cut into terms and counted where it is read; nothing is shuffled but frequencies."""
    return _indexed(_segment(corpus, han_bigrams, 0), han_bigrams, 1)


def _living(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """The postings without documents of ``ids`` (id): only shards that hold one are changed."""
    held = postings.where("term is null").select("shard", F.explode(F.arrays_zip("nos", "ids")).alias("d")).select("shard", F.col("d.nos").alias("no"), F.col("d.ids").alias("id"))
    dead = stored(held.join(ids.select("id").distinct(), "id", "left_semi").groupBy("shard").agg(F.collect_list("no").alias("dead")), "dead")
    rows = postings.join(dead, "shard", "left")

    def side(column: str) -> Column:
        pairs = F.filter(F.arrays_zip("nos", column), lambda x: ~F.array_contains("dead", x["nos"]))
        return F.when(F.col("dead").isNull() | F.col(column).isNull(), F.col(column)).otherwise(F.transform(pairs, lambda x: x[column])).alias(column)

    nos = F.when(F.col("dead").isNull(), F.col("nos")).otherwise(F.filter("nos", lambda x: ~F.array_contains("dead", x))).alias("nos")
    rows = rows.select("shard", "term", F.size(nos).alias("n"), nos, *[side(c) for c in ("counts", "places", "ids")])
    return rows.where("n > 0")


def extended(index: LexicalIndex, corpus: DataFrame) -> LexicalIndex:
    """The index with a further segment of ``corpus`` (id, pos, text): earlier segments are read, not written again, and lose the documents that come again."""
    added = _segment(corpus, index.han_bigrams, index.segments)
    return _indexed(_living(index.postings, corpus.select("id")).unionByName(added), index.han_bigrams, index.segments + 1)


def without(index: LexicalIndex, ids: DataFrame) -> LexicalIndex:
    """The index without the documents of ``ids`` (id)."""
    return _indexed(_living(index.postings, ids), index.han_bigrams, index.segments)


def compacted(index: LexicalIndex) -> LexicalIndex:
    """The same index, its living postings written as one table."""
    return _indexed(stored(index.postings, "postings"), index.han_bigrams, index.segments)


def _best(acc: np.ndarray, k: int) -> float:
    return float(np.partition(acc, -k)[-k]) if len(acc) >= k else 0.0


def _one(rows: np.ndarray, weights: np.ndarray, tops: np.ndarray, starts: np.ndarray, nos: np.ndarray, shares: np.ndarray, acc: np.ndarray, k: int | None, least: float) -> np.ndarray:
    """Sums a question's scores into ``acc`` and returns the documents that can be among its first ``k``.

    Terms come by falling bound (weight times the term's largest share in the shard). Once what is left cannot lift an unseen
    document to the threshold (the ``k``-th sum so far, or ``least``), the other terms are only looked up for documents that can still reach it.
    """
    order = np.argsort(-weights * tops[rows], kind="stable")
    rows, weights = rows[order], weights[order]
    rest = np.concatenate([np.cumsum((weights * tops[rows])[::-1])[::-1], [0.0]])
    bounded = k is not None and not (weights < 0).any()
    threshold, at = max(least, 0.0), 0
    while at < len(rows) and not (bounded and rest[at] < threshold - MARGIN):
        part = slice(starts[rows[at]], starts[rows[at] + 1])
        acc[nos[part]] += weights[at] * shares[part]
        at += 1
        if bounded and at % 4 == 0 and rest[at] <= acc.max():
            threshold = max(threshold, _best(acc, k))
    able = np.flatnonzero((acc > 0) & (acc + rest[at] >= threshold - MARGIN) if bounded else acc != 0)
    for j in range(at, len(rows)):
        part = slice(starts[rows[j]], starts[rows[j] + 1])
        own = nos[part]
        place = np.minimum(np.searchsorted(own, able), len(own) - 1)
        hit = own[place] == able
        acc[able[hit]] += weights[j] * shares[part][place[hit]]
        able = able[acc[able] + rest[j + 1] >= threshold - MARGIN]
    return able


def _scored(mean: float, k: int | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def shard_scores(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        absent = table["term"].is_null().to_numpy()
        docs = table.filter(pa.array(absent)).slice(0, 1)
        present, lengths, places = (docs[c].combine_chunks().flatten().to_numpy() for c in ("nos", "counts", "places"))
        ids = docs["ids"].combine_chunks().flatten()
        n = int(present.max()) + 1
        norm, place, index = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        norm[present] = K1 * (1 - B + B * lengths / mean) if mean else K1
        place[present], index[present] = places, np.arange(len(present))
        table = table.filter(pa.array(~absent))
        lists, asked = table["nos"].combine_chunks(), table["asked"].combine_chunks()
        starts, nos = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
        counts = table["counts"].combine_chunks().flatten().to_numpy()
        shares = counts * (K1 + 1) / (counts + norm[nos])
        tops = np.maximum.reduceat(shares, starts[:-1]) if len(nos) else np.empty(0)
        each = asked.flatten()
        qno, weight, least = (each.field(f).to_numpy() for f in ("qno", "weight", "least"))
        row = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
        order = np.argsort(qno, kind="stable")
        qno, weight, least, row = qno[order], weight[order], least[order], row[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(qno)) + 1, [len(qno)]]) if len(qno) else [0]
        acc, found = np.zeros(n), []
        for a, b in zip(cuts[:-1], cuts[1:]):
            able = _one(row[a:b], weight[a:b], tops, starts, nos, shares, acc, k, least[a])
            if k is not None and len(able) > k:  # all that may share the k-th place after rounding
                able = able[acc[able] >= _best(acc[able], k) - MARGIN]
            found.append((np.full(len(able), qno[a]), able, acc[able].copy()))
            acc[:] = 0
        asked_by, able, score = (np.concatenate([f[c] for f in found]) if found else np.empty(0, np.int64) for c in range(3))
        able = able.astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(asked_by, pa.int64()), ids.take(pa.array(index[able])), pa.array(place[able], pa.int64()), pa.array(score, pa.float64())], ["qno", "id", "pos", "score"])

    def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], None
        for batch in batches:
            own = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and own[a] != shard:
                    yield shard_scores(pa.Table.from_batches(held))
                    held = []
                shard = own[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield shard_scores(pa.Table.from_batches(held))

    return scores


def _shard_hits(index: LexicalIndex, postings: DataFrame, weighted: DataFrame, k: int | None) -> DataFrame:
    """(qno, id, pos, score) from ``weighted`` (qno, term, weight, least): each shard's candidates for the first ``k``, or all."""
    by_term = weighted.groupBy("term").agg(F.collect_list(F.struct("qno", "weight", "least")).alias("asked"))
    terms = weighted.select(F.col("term").alias("wanted")).distinct()
    # a block of questions is bounded, so its terms and weights go to every task; of the postings only asked terms are dealt by shard
    spark = postings.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4 * index.shards, 4 * spark.sparkContext.defaultParallelism))
    kept = postings.join(F.broadcast(terms), postings["term"] == F.col("wanted"), "left").where("term is null or wanted is not null").drop("wanted").repartition(parts, "shard")
    dealt = kept.join(F.broadcast(by_term), "term", "left").sortWithinPartitions("shard")
    schema = StructType().add("qno", LongType()).add("id", index.postings.schema["ids"].dataType.elementType).add("pos", LongType()).add("score", DoubleType())
    return dealt.select("shard", "term", "nos", "counts", "places", "ids", "asked").mapInArrow(_scored(index.mean, k), schema)


def bm25_scores(index: LexicalIndex, queries: DataFrame, k: int | None = None, leading: int = LEADING) -> DataFrame:
    """(qid, id, pos, score) for ``queries`` (qid, text), a repeated term counting again; with ``k`` at least the first ``k`` of every query.

    Each shard ranks its own documents, leaving out postings that cannot lift a document to the threshold. Of more than
    ``leading`` shards a sixteenth is ranked first, and its ``k``-th scores are the thresholds of the others.
    """
    named = queries.select("qid", tokens(F.col("text"), index.han_bigrams).alias("terms")).groupBy("qid").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    named = stored(named.withColumn("qno", F.monotonically_increasing_id()), "asked")
    asked = named.select("qno", F.explode("terms").alias("term")).groupBy("qno", "term").agg(F.count("*").alias("times"))
    weighted = stored(asked.join(index.terms, "term").select("qno", "term", (F.col("times") * F.col("idf")).alias("weight"), F.lit(0.0).alias("least")), "weights")
    blocks, found = max(1, -(-weighted.count() // ASKED_BLOCK)), None
    for block in range(blocks):
        own = weighted if blocks == 1 else weighted.where(F.pmod(F.xxhash64("qno"), F.lit(blocks)) == block)
        if k is None or index.shards <= leading:
            hits = _shard_hits(index, index.postings, own, k)
        else:
            first = F.pmod(F.xxhash64("shard"), F.lit(16)) == 0
            ahead = stored(_shard_hits(index, index.postings.where(first), own, k), "ahead")
            best = Window.partitionBy("qno").orderBy(F.desc("score"))
            least = ahead.withColumn("place", F.row_number().over(best)).where(F.col("place") == k).select("qno", F.col("score").alias("known"))
            others = own.join(least, "qno", "left").select("qno", "term", "weight", F.coalesce("known", "least").alias("least"))
            hits = ahead.unionByName(_shard_hits(index, index.postings.where(~first), others, k))
        found = hits if found is None else found.unionByName(hits)
    return found.join(named.select("qno", "qid"), "qno").select("qid", "id", "pos", F.round("score", 6).alias("score"))


def bm25_rank(index: LexicalIndex, queries: DataFrame, k: int | None = TOP_K, leading: int = LEADING) -> DataFrame:
    """(qid, id, score, rank): positive scores only, ties in corpus order, at most ``k`` for each query."""
    ranked = bm25_scores(index, queries, k, leading).where("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "pos")))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).select("qid", "id", "score", "rank")
