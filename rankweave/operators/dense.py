"""Exact vector ranking of a batch of queries, in blocks of vectors and queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DoubleType, FloatType, StructType

TOP_K, EMBED_BATCH = 20, 32
#: Vectors and queries that meet in a task at a time; vectors of a block at least; queries scored at once; pairs scored exactly at once.
VECTOR_BLOCK, QUERY_BLOCK, LEAST_BLOCK, TILE, PAIRS = 16_384, 4_096, 1_024, 256, 65_536
#: Queries that are broadcast at once where scores have no matrix form.
SENT = 512
#: Scores are rounded to six places: what is farther apart keeps its order.
STEP = 1.1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearness(a: Column, b: Column) -> Column:
    """The sum of the differences of the coordinates, below zero."""
    return -F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def _dots(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dot products of the rows of ``q`` with those of ``x`` in single precision, and how far each row of them may be off."""
    return q.astype(np.float32) @ x.astype(np.float32).T, np.linalg.norm(q, axis=1) * _longest(x)


def _nearnesses(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, columns, q4 = np.zeros((len(q), len(x)), np.float32), np.ascontiguousarray(x.T, np.float32), q.astype(np.float32)
    for i in range(0, len(q), 16):
        for j in range(0, len(x), 4096):  # so much stays in a core's cache
            part, sums = columns[:, j : j + 4096], found[i : i + 16, j : j + 4096]
            off = np.empty(sums.shape, np.float32)
            for d in range(len(columns)):
                np.subtract(part[d], q4[i : i + 16, d, None], out=off)
                np.abs(off, out=off)
                sums -= off
    return found, x.shape[1] ** 0.5 * (np.linalg.norm(q, axis=1) + _longest(x))


def _longest(x: np.ndarray) -> float:
    return float(np.linalg.norm(x, axis=1).max(initial=0.0))


#: For a score of pairs, all scores in single precision, and the summands of the exact one.
_FAST: dict[Callable, tuple[Callable, Callable]] = {dot: (_dots, lambda x, q: x * q), nearness: (_nearnesses, lambda x, q: -np.abs(x - q))}


def _shapes(column: pa.Array) -> np.ndarray:
    """The length of every vector, -1 where an element is null."""
    lengths, values = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()
    if values.null_count:
        lengths[np.repeat(np.arange(len(lengths)), lengths)[pc.is_null(values).to_numpy(zero_copy_only=False)]] = -1
    return lengths


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.float64)


def _bounded(x: np.ndarray) -> np.ndarray:
    """Which rows hold numbers that single precision can multiply."""
    return (np.abs(x) < 1e15).all(axis=1)


def _plain(x: np.ndarray) -> np.ndarray:
    """Which rows single precision serves: bounded ones, less the few that are much longer than the others and would blur these."""
    plain = _bounded(x)
    length = np.linalg.norm(np.where(plain[:, None], x, 0.0), axis=1)
    return plain & (length <= 100 * np.quantile(length[plain], 0.9)) if plain.any() else plain


def _first_alike(x: np.ndarray, k: int) -> np.ndarray:
    """The places of the first ``k`` of equal rows."""
    if not x.size:
        return np.arange(min(len(x), k))
    _, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
    return np.sort(_first_of_runs(group, np.argsort(group, kind="stable"), k))


def _first_of_runs(keys: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Of ``order``, which sorts ``keys``, the first ``k`` places of every key."""
    new = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    return order[np.arange(len(order)) - np.repeat(new, np.diff(np.r_[new, len(order)])) < k]


def _cut(found: np.ndarray, k: int) -> np.ndarray:
    """A bound for every row that at least ``k`` of its values reach: the k-th of the greatest of strips of columns."""
    if found.shape[1] <= k:
        return np.full(len(found), -np.inf)
    width = -(-found.shape[1] // max(1, found.shape[1] // (8 * k)))
    tops = found[:, :width].copy()
    for at in range(width, found.shape[1], width):
        part = found[:, at : at + width]
        np.maximum(tops[:, : part.shape[1]], part, out=tops[:, : part.shape[1]])
    return np.partition(tops, -k, axis=1)[:, -k]


def _exact(x: np.ndarray, q: np.ndarray, rows: np.ndarray, columns: np.ndarray, summands: Callable) -> np.ndarray:
    """Scores in double precision, added up from the first coordinate as in the column expressions."""
    scores = np.empty(len(rows))
    for at in range(0, len(rows), PAIRS):
        r, c = rows[at : at + PAIRS], columns[at : at + PAIRS]
        parts = np.zeros((len(r), x.shape[1] + 1))
        parts[:, 1:] = summands(x[c], q[r])
        scores[at : at + PAIRS] = np.add.accumulate(parts, axis=1)[:, -1]
    return scores


def _leading(rows: np.ndarray, columns: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the pairs that may be among the first ``k`` of their row once scores are rounded; NaN comes first, as in Spark."""
    no_number = np.isnan(scores)
    top = np.where(no_number, np.inf, scores)
    order = np.lexsort((columns, -top, ~no_number, rows))
    begin = np.flatnonzero(np.r_[True, rows[order][1:] != rows[order][:-1]])
    size = np.diff(np.r_[begin, len(order)])
    least = np.repeat(top[order][begin + np.minimum(size, k) - 1], size)
    changed = np.r_[True, (np.diff(rows[order]) != 0) | (top[order][1:] != top[order][:-1]) | (np.diff(no_number[order].astype(int)) != 0)]
    run = np.maximum.accumulate(np.where(changed, np.arange(len(order)), 0))
    return order[(top[order] >= least - STEP) & (np.arange(len(order)) - run < k)]


def _best(x: np.ndarray, q: np.ndarray, k: int, coarse: Callable, summands: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of ``q``, rows of ``x``, scores) that hold the first ``k`` of every row of ``q``; rows of ``x`` are in the order of their ids."""
    alike = _first_alike(x, k)
    x = x[alike]
    plain = _plain(x)
    usual, odd, x_plain = np.flatnonzero(plain), np.flatnonzero(~plain), x[plain]
    for at in range(0, len(q), TILE):
        tile = q[at : at + TILE]
        fits = _bounded(tile)
        found, off = coarse(x_plain, np.where(fits[:, None], tile, 0.0))
        margin = 2 * STEP + 2 * (x.shape[1] + 4) * 2.0**-24 * off
        mask = found >= (_cut(found, k) - margin)[:, None]
        mask[~fits] = True
        rows, columns = np.nonzero(mask)
        rows, columns = np.r_[rows, np.repeat(np.arange(len(tile)), len(odd))], np.r_[usual[columns], np.tile(odd, len(tile))]
        scores = _exact(x, tile, rows, columns, summands)
        if len(rows):
            led = _leading(rows, columns, scores, k)
            yield at + rows[led], alike[columns[led]], scores[led]


def _met(k: int, coarse: Callable, summands: Callable) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def met(key: tuple, vectors: pa.Table, asked: pa.Table) -> pa.Table:
        vectors = vectors.take(pc.sort_indices(vectors, [("id", "ascending")]))
        ids, qids = vectors["id"].combine_chunks(), asked["qid"].combine_chunks()
        x, q = vectors["embedding"].combine_chunks(), asked["asked"].combine_chunks()
        shapes, wanted = _shapes(x), _shapes(q)
        pieces = []
        for width in np.unique(wanted):
            own, same = np.flatnonzero(wanted == width), np.flatnonzero((shapes == width) & (width >= 0))
            if len(same):
                with np.errstate(invalid="ignore", over="ignore"):
                    for rows, columns, scores in _best(_matrix(x.take(pa.array(same)), width), _matrix(q.take(pa.array(own)), width), k, coarse, summands):
                        pieces.append((own[rows], same[columns], pa.array(scores)))
            others = np.flatnonzero((shapes != width) | (width < 0))[:k]  # these have no score, and come last
            if len(others):
                pieces.append((np.repeat(own, len(others)), np.tile(others, len(own)), pa.nulls(len(own) * len(others), pa.float64())))
        tables = [pa.table({"qid": qids.take(pa.array(rows)), "id": ids.take(pa.array(columns)), "score": scores}) for rows, columns, scores in pieces]
        return pa.concat_tables(tables) if tables else pa.table({"qid": qids[:0], "id": ids[:0], "score": pa.array([], pa.float64())})

    return met


def _first_scores(vectors: DataFrame, queries: DataFrame, k: int, fast: tuple[Callable, Callable]) -> DataFrame:
    """(qid, id, score) that hold the first ``k`` of every query: blocks of vectors meet blocks of queries, each pair of them in one task."""
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    n = vectors.select("id").count()
    blocks = max(1, -(-n // VECTOR_BLOCK), min(2 * parallel, n // LEAST_BLOCK))
    chunks = max(1, -(-queries.select("qid").count() // QUERY_BLOCK))
    single = all(df.schema["embedding"].dataType.elementType == FloatType() for df in (vectors, queries))
    value = F.col("embedding").cast("array<float>" if single else "array<double>")
    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ("block", "chunk")
    left = vectors.where("embedding is not null").select(dealt("id", blocks).alias("block"), every(chunks).alias("chunk"), F.col("id").alias("id"), value.alias("embedding"))
    right = queries.where("embedding is not null").select(every(blocks).alias("block"), dealt("qid", chunks).alias("chunk"), F.col("qid").alias("qid"), value.alias("asked"))
    left, right = (side.repartition(blocks * chunks, *keys) for side in (left, right))
    schema = StructType().add("qid", queries.schema["qid"].dataType).add("id", vectors.schema["id"].dataType).add("score", DoubleType())
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_met(max(1, k), *fast), schema)


def dense_rank(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, score: Callable[[Column, Column], Column] = dot) -> DataFrame:
    """(qid, id, score, rank) of the ``k`` nearest ``vectors`` (id, embedding) of every query (qid, embedding).

    Blocks of vectors meet blocks of queries. By :func:`dot` and :func:`nearness` a task scores its pairs as matrices in single
    precision and again in double precision those that may be among the first ``k``; other scores are compared pair by pair.
    Each task keeps its own best ``k`` of a query before anything is shuffled. Ties go to the smaller id; vectors or queries
    without embedding have no rank.
    """
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    if score in _FAST:
        pairs = _first_scores(vectors, queries, k, _FAST[score]).withColumn("score", F.round("score", 6))
        return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    vectors = vectors.where("embedding is not null").select("id", "embedding")
    queries = queries.where("embedding is not null").select("qid", F.col("embedding").alias("asked"))
    blocks = max(1, -(-queries.count() // SENT))
    ranked = None
    for block in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block)
        pairs = vectors.crossJoin(F.broadcast(own)).select("qid", "id", F.round(score(F.col("asked"), F.col("embedding")), 6).alias("score"))
        found = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ranked = found if ranked is None else ranked.unionAll(found)
    return ranked


def embedded(corpus: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "text", prefix: str = "") -> DataFrame:
    """Adds ``embedding`` by an injected model; it gets EMBED_BATCH texts at a time, and each worker loads it once."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [prefix + (t or "") for t in batch]
            yield pd.Series([v for at in range(0, len(texts), EMBED_BATCH) for v in embed(texts[at : at + EMBED_BATCH])], dtype=object)

    return corpus.withColumn("embedding", vectors(F.col(text)))
